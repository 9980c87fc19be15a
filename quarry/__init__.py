"""quarry: a PySpark-native engine for retrieval over source code and documentation."""
