"""Training-data operators: scoring, sharding, deduplication, tokenisation.

Nothing else in the library imports this subpackage.
"""
