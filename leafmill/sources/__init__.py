"""Readers that turn raw tables and logs into document tables, and sinks."""
