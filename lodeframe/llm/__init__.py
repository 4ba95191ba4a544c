"""Training-data operators: scoring, filtering, de-duplication, mixing and sharding of document tables.

Nothing else in the library imports this package.
"""
