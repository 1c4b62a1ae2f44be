"""Recursive rules over relational data on Spark: relations, merge functions, terms modulo equality, extraction."""
