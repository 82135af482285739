"""Structured Streaming jobs over the search event stream."""
