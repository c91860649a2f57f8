"""Operators for text corpora, their queries and SQL. Nothing else in the package imports this folder."""
