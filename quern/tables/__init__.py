"""Versioned tables: immutable Parquet files under JSON metadata, replaced atomically."""
