"""Spark-native analytics over corpora of paired texts."""
