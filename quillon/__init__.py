"""Spark-native analytics over collections of embedded items."""
