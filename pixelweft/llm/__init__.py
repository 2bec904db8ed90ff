"""Operators for preparing training data: dedup, search, scoring, sharding, tokens.

Nothing outside this subpackage imports it.
"""
