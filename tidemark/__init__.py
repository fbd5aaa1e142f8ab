"""A Spark-native engine for indexing event logs."""
