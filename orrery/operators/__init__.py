"""Calibration, geometry, aggregation, graph, similarity, detection and screening operators."""
