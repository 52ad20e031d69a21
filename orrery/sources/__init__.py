"""Readers, joins and transforms of source tables, and the versioned store."""
