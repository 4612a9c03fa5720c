"""Operators for large training-data pipelines, each a DataFrame function."""
