"""Plate-read analytics as DataFrame, SQL and Structured Streaming operators."""

__version__ = "0.1.0"
