"""Structured Streaming versions of the live-reading operators."""
