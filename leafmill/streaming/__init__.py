"""Structured Streaming forms of ingest, debounce and dirty-path tracking."""
