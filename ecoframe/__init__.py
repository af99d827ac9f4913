"""Biodiversity analytics as Spark plans: DataFrame in, DataFrame out."""

__version__ = "0.1.0"
