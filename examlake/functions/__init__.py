"""Spark-native examination analytics: functions."""
