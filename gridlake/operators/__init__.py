"""Operators on frames: frames in, frames out."""
