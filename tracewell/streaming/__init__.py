"""Stateful Structured Streaming jobs."""
