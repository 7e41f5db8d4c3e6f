"""Operators over catalog, index and fact tables."""
