"""Readers, sinks and the canonical frames."""
