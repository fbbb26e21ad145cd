"""Structured Streaming forms of ingest and windows."""
