"""Spark-native examination analytics: sources."""
