"""Spark-native engine for collecting, cleaning and querying listings."""

__version__ = "0.1.0"
