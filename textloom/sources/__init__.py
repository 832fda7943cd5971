"""Readers, and the logical tables over the supplied parquet files."""
