"""Spark-native analytics for semi-structured incident reports and the places they affect."""
