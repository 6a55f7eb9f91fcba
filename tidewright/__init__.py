"""Spark-native inundation analytics: duration at depth for gridded landscapes."""

__version__ = "0.1.0"
