"""Versioned key-value analytics on Spark SQL."""

__version__ = "0.1.0"
