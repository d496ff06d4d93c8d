"""Spark-native analytics for public posts about cities."""

__version__ = "0.1.0"
