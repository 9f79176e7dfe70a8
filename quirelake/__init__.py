"""Quirelake: search, merge and analysis of open-access literature records on Spark."""

__version__ = "0.1.0"
