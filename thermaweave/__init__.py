"""Extreme events in gridded daily time series, as Spark jobs."""

__version__ = "0.3"
