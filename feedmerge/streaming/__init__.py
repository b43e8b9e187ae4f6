"""Structured Streaming: alarm evaluation over metric streams and
incremental ingest of arriving feed files."""
