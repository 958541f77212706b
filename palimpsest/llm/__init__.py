"""Operators for preparing training text: deduplication, privacy, mixing, tokenising, media."""
