"""Operators for large collections of training text. Nothing else in the library imports this package."""
