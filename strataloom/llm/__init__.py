"""Operators that prepare training data: extraction, filtering, deduplication, tokens and packing."""
