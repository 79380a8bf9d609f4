"""A Spark-native engine for keyed, schemaless records."""
