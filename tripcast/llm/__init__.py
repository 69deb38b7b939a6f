"""Operators for preparing training text: packing, deduplication, extraction, scoring, search."""
