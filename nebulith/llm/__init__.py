"""Operators for text corpora and record linkage. Nothing outside this package imports it."""
