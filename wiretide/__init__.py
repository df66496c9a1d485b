"""Spark-native analysis of network captures and of large text corpora."""

__version__ = "0.1.0"
