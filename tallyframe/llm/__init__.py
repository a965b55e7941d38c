"""Operators for training data: cleaning, joining, encoding and laying out documents."""
