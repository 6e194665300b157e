"""Structured Streaming collection."""
