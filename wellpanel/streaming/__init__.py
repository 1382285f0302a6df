"""Structured Streaming jobs; every transformation also runs on batch tables."""
