"""Freshet: watershed time-series analytics as Spark DataFrame operations."""
