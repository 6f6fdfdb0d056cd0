"""Relational operators of record linkage."""
