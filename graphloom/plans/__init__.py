"""Datasets and registered queries."""
