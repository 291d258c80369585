"""Spark-native analytics for structural patterns in keyed time series."""
