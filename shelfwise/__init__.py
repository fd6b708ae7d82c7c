"""Retail analytics on Spark DataFrames."""
