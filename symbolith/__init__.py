"""Spark-native analytics over symbol annotations and their predictions."""
