"""Retrieval analytics over text and vectors on Spark DataFrames."""
