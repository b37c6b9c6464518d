"""Catalog, readers and sinks."""
