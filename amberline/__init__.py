"""Amberline: a Spark-native lakehouse engine for half-hourly energy-market time series."""
