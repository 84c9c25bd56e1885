"""Readers of the source files."""
