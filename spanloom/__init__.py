"""Ranked full-text search on Spark DataFrames."""
