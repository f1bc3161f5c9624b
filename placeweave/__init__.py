"""Spark-native engine for collecting, normalising and reconciling place records."""

__version__ = "0.1.0"
