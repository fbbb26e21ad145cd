"""Ingest, change logs, table bindings and sinks."""
