"""A Spark-native engine for panel, composition and network analytics."""
