"""Operators: each takes a DataFrame and gives one back, so they chain with ``transform``."""
