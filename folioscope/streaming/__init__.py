"""Structured Streaming versions of the usage counters."""
