"""Spark operators for networks of hourly weather stations."""

__version__ = "0.1.0"
