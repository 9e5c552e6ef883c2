"""Spark-native geospatial SQL analytics engine."""

__version__ = "0.1.0"
