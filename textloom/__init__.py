"""textloom: a PySpark-native engine for scoring and auditing collections of texts."""
