"""Operators for large training-data pipelines, each over Spark DataFrames."""
