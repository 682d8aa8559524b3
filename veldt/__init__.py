"""Veldt: a compact, declarative SQL dialect that compiles to DataFrame operations."""
