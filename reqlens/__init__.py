"""Spark-native analytics for language-model anomaly detection on web requests."""

__version__ = "0.1.0"
