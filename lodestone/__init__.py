"""Lodestone: evidence retrieval, evaluation and corpus processing on Spark DataFrames."""

__version__ = "0.1.0"
