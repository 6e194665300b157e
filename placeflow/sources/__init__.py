"""Readers and writers of recorded responses and collections."""
