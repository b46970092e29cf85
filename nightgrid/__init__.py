"""Spark-native analytics for long physiological and event time series."""

__version__ = "0.1.0"
