"""Structured Streaming jobs over status events."""
