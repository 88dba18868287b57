"""Relational operators of document analysis."""
