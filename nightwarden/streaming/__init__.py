"""Structured Streaming forms of the batch plans."""
