"""Schemas, loading and storage layout of the claims tables."""
