"""Spark-native document comparison: what changed between many pairs of documents."""

__version__ = "0.1.0"
