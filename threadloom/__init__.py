"""threadloom: retrieval analytics over conversation archives, written for Spark DataFrames."""

__version__ = "0.1.0"
