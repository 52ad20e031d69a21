"""Incremental calibration state and Structured Streaming scoring."""
