"""Spark-native analytics for imaging sessions with scored behaviour."""
