"""Spark-native catalogue matching, de-duplication and metadata review."""
