"""Genomic interval and sequencing-evidence analytics as PySpark jobs."""

__version__ = "0.1.0"
