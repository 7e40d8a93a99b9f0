"""Spark-first analytics engine for point-in-time text-and-returns research."""

__version__ = "0.1.0"
