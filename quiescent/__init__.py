"""Spark-first analytics for dense multichannel time series."""
