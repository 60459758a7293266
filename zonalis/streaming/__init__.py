"""Structured Streaming jobs over arriving fields."""
