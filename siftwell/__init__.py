"""Spark-native hybrid retrieval and analytics over document knowledge bases."""

__version__ = "0.1.0"
