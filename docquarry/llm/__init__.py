"""Operators for building training corpora out of document tables."""
