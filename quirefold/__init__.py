"""Spark-native preparation, search and audit of large text collections."""
