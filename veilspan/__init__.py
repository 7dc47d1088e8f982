"""Span-level privacy analytics on Spark DataFrames."""
