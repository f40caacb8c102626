"""Incremental loading of new claims files."""
