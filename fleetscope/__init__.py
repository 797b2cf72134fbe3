"""Operational analytics over database fleets as composable Spark DataFrame operators."""

__version__ = "0.1.0"
