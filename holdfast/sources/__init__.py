"""Readers, writers and the run-versioned Parquet tables."""
