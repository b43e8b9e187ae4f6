"""Sinks: deterministic CSV feeds and JSON reports."""
