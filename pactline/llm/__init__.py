"""Operators for preparing training text: sharding, tokens, deduplication, quality, packing."""
