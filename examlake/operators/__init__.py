"""Spark-native examination analytics: operators."""
