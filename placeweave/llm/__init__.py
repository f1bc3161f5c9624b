"""Operators for training data, each a DataFrame in and a DataFrame out."""
