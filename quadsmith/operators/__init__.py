"""Operators beyond the algebra: search, validation, rules, merging, history."""
