"""Operators for training data: quality, duplicates, search, secrets, formatting, packing."""
