"""Readers, loaders and append-only sinks."""
