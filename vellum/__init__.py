"""Spark-native analytics for multilingual structured-text collections."""
