"""Operators on texts and on matching for training data; nothing else in the library imports this package."""
