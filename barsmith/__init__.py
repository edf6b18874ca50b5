"""Bar analytics on Spark: candlestick storage, quality, indicators and streams."""

__version__ = "0.1.0"
