"""Spark-first text quality, spelling, grammar and similarity analytics."""

__version__ = "0.1.0"
