"""Relational operators of the analysis."""
