"""Spark jobs over source-code structure, text and event tables."""

__version__ = "0.1.0"
