"""Spark-native text, taxonomy and search analytics."""
