"""Examination analytics as pure DataFrame functions on Spark."""
