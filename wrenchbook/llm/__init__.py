"""Operators for training-data pipelines: deduplication, filtering, scoring, formatting and tokens.

Nothing outside this package imports it. All operators take and return DataFrames; ``queries``
binds them to the tables of a directory.
"""
