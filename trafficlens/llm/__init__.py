"""Operators for preparing training data: each is a DataFrame function with its own general interface."""
