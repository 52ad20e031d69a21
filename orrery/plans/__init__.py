"""Typed specifications, configuration, and the query registry."""
