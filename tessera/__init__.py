"""Spark-native analytics over entity, text and embedding tables."""

__version__ = "0.1.0"
