"""Columns from columns, and table functions over source text."""
