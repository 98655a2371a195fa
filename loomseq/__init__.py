"""Reversible sequence transforms and full-text search on Spark DataFrames."""
