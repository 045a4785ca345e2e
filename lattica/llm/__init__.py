"""Operators for building language-model training data; no other part of the library imports this package."""
