"""Operators for training data: text, vectors and urls. Nothing else in the library imports this folder."""
