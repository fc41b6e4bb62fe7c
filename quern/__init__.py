"""quern: a PySpark-native feature and analytics engine for large tabular data."""
