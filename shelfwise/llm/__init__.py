"""Operators that prepare training data: extraction, tokens, scans, near and exact duplicates, quality, search,
archives, personal data and packing. Nothing else in the library imports this folder."""
