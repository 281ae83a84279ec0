"""Operators on streams; all of them take batch DataFrames too, where that makes sense."""
