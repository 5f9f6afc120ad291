"""Whole analyses: scoring and the one-row-per-product document."""
