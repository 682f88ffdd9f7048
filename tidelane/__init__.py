"""Tidelane: Spark-first analytics over event, interval and sampled-signal tables."""

__version__ = "0.1.0"
