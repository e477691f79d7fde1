"""Structured Streaming jobs: incremental ingest, scoring of new rows, daily score aggregates."""
