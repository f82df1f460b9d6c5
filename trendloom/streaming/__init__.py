"""Structured Streaming forms of the recurring load and refresh."""
