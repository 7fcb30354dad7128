"""Operators of a training-data pipeline (filtering, deduplication, mixing, packing).

Nothing else in the library imports this subpackage. ``queries.py`` holds the registered
queries and their DuckDB twins.
"""
