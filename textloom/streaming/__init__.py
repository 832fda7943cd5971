"""Structured Streaming: change feeds and sliding counts."""
