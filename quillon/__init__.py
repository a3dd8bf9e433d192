"""Spark-native privacy analytics: detection, tokenisation, leak gates and run analytics."""
