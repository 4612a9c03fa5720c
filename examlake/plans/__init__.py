"""Spark-native examination analytics: plans."""
