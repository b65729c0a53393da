"""Operators for preparing training text: deduplication, quality, language, mixing, packing, archives."""
