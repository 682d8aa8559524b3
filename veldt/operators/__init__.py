"""Operators of a bound query: joins, bounds of generated tables, grouping."""
