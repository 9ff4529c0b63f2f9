"""Operators for building training data from web text. Nothing outside this package imports it."""
