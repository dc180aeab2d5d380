"""Spark-first analytics for particle, gas-cell and adaptive-mesh snapshots."""

__version__ = "0.1.0"
