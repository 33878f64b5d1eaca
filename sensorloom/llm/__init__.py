"""Operators for preparing training text: deduplication, filtering, tokenising, sharding and packing."""
