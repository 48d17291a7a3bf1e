"""Panels from stored tables, ingestion transforms, caches and sinks."""
