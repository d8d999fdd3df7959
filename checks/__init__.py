"""Queries over the driver tables, their SQL oracle, and a comparison of the two."""
