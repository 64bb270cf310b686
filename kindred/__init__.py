"""Similarity and de-duplication analytics on Spark DataFrames."""
