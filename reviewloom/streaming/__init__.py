"""Structured Streaming forms of the growth series and of review scoring."""
