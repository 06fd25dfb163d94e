"""Hybrid entity search and data preparation on Spark DataFrames."""
