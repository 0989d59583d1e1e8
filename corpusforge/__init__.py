"""Corpus question answering and training-data processing on Spark DataFrames."""
