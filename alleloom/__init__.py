"""Genetic association analytics on Spark DataFrames."""
