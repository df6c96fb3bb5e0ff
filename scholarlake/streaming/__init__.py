"""Structured Streaming forms of the incremental processes."""
