"""Strata: a Spark-native ELT engine whose datasets remember every build."""

__version__ = "0.1.0"
