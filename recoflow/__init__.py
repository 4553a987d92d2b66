"""Recommendation and ranking analytics on Spark DataFrames."""
