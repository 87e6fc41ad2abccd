"""Folded-stack profile analytics planned entirely as Spark DataFrames."""

__version__ = "0.2.0"
