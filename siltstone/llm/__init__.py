"""Operators for preparing training data from the lake. Nothing outside this package imports it."""
