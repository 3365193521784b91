"""Operators for training-data work on texts, vectors and names. Nothing outside imports this package."""
