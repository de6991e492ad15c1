"""Readers: parquet tables, source trees, JSON lines, logs and stack traces."""
