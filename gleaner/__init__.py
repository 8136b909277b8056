"""Gleaner: a Spark-native content-scanning and corpus-processing engine."""

__version__ = "0.1.0"
