"""Spark-native analytics for directed contact data and for large text corpora."""
