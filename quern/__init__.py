"""quern: a PySpark-native analytics engine over versioned Parquet tables."""
