"""Spark-first analytics over pages of recognised text: normalise, extract, match, measure and split."""

__version__ = "0.1.0"
