"""Gridded geospatial and historical analytics as Spark DataFrame operations."""
