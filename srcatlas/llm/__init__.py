"""Operators for preparing training text: dedup, filters, mixing, sharding."""
