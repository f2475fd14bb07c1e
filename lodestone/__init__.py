"""Lodestone: a Spark-native vector search and analytics engine."""

__version__ = "0.1.0"
