"""Exact numbers, JSON and text analysis."""
