"""Spark-native code and text search engine with incremental maintenance and corpus preparation."""

__version__ = "0.1.0"
