"""Operators on texts and algorithms for training data."""
