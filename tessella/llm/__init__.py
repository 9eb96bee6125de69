"""Operators for preparing text corpora, independent of the rest of the library."""
