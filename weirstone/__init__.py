"""Spark-first analytics for community activity data."""

__version__ = "0.1.0"
