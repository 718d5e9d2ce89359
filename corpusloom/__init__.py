"""Corpus curation and token-stream analytics on Spark DataFrames."""
