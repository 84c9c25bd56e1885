"""Streams over status snapshots."""
