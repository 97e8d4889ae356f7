"""Structured Streaming into an index."""
