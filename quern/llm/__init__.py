"""Operators for building training data from large text corpora. Nothing outside this package imports it."""
