"""LexiSpark: full-text retrieval and faceting on PySpark DataFrames."""

__version__ = "0.1.0"
