"""Spark-native full-text index, query speller and proximity search."""
