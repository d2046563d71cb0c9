"""A Spark-native analytics engine for event traces."""
