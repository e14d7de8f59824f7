"""Incremental ingest of new assemblies."""
