"""Spark-native temporal co-presence analytics."""
