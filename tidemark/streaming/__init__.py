"""Structured Streaming jobs; each has the same result as its batch form."""
