"""Operators for preparing training text: scans, filters, near-duplicates, packing and sharding."""
