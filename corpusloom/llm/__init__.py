"""Operators that prepare text at training-data scale; nothing outside this package imports it."""
