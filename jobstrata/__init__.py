"""Longitudinal analytics over archived job postings, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
