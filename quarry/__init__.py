"""A PySpark-native engine for semantic discovery, data views and corpus preparation."""
