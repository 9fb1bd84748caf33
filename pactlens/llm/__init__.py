"""Operators for large text corpora used as training data, one module each."""
