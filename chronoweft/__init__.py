"""Spark-native analytics over partially ordered event data."""

__version__ = "0.1.0"
