"""Spark-native analytics over announcement corpora."""
