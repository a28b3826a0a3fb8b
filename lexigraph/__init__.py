"""Spark-native analytics over text collections and entity graphs."""
