"""barline: panel analytics for market-style time series, written as Spark jobs."""

__version__ = "0.1.0"
