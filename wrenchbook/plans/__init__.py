"""Bindings of the star-schema tables to the domain tables, and the query registry."""
