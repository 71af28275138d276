"""Palimpsest: a PySpark engine for bitemporal claim archives and evidence retrieval."""
