"""Temporal knowledge-graph memory on Spark DataFrames."""
