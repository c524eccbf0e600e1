"""Structured Streaming forms of the intake, replay and job operators."""
