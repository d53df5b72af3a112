"""Spark-first engine for typed property graphs, retrieval and usage analytics."""

__version__ = "0.1.0"
