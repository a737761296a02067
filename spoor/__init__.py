"""Spark-native analytics over trails of hash-linked agent-action records."""

__version__ = "0.1.0"
