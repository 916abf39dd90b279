"""Structured Streaming forms of the mergeable aggregates."""
