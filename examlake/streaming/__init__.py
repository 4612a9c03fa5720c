"""Spark-native examination analytics: streaming."""
