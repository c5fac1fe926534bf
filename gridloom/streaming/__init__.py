"""Structured Streaming form of the hourly resample."""
