"""Operators for preparing training text: dedup, filters, packing, extraction."""
