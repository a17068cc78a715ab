"""A Spark-native text retrieval and analytics engine."""
