"""Operators that prepare a text corpus for training: near-duplicate and passage removal,
extraction, filters, token counts, scoring, mixing and packing."""
