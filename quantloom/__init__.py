"""Spark-native analytics for date-by-symbol panels."""
