"""Operators that prepare training text: mixing, language, quality, licences, duplicates, packing, extraction, search."""
