"""Spark-native engine for finding copied material in collections of submissions."""

__version__ = "0.1.0"
