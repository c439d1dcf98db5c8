"""Corpus preparation operators: each module is one operator, queries.py registers them."""
