"""Structured Streaming forms of the append operators."""
