"""Training-data operators: scoring, deduplication, search, archives and tokens.

The rest of the library does not import this package.
"""
