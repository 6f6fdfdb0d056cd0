"""Linkage of records that keep arriving."""
