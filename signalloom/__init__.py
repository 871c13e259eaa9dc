"""Positional signal analytics on Spark DataFrames."""
