"""Structured Streaming versions of operators that make sense on unbounded input."""
