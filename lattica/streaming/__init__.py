"""Structured Streaming forms of the batch readers."""
