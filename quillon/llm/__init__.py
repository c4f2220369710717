"""Operators for preparing training data: tokenising, deduplicating, mixing, packing, formatting.

Nothing outside this folder imports it; the rest of the library works without it.
"""
