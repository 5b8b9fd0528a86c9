"""Incremental parameter tables."""
