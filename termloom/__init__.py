"""Spark-native full-text ranked retrieval."""
