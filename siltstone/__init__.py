"""Siltstone: relational, key-value, versioned and streaming queries on PySpark."""
