"""Operators for preparing training text: near-duplicates, quality, language, mixing, packing and token files."""
