"""Operators for building training corpora: each module is one operator, queries.py registers them."""
