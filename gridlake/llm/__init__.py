"""Operators that prepare training text: sharding, deduplication, decontamination, tokenizing, scoring.

Nothing outside this subpackage imports it.
"""
