"""ragspark: retrieval analytics on Spark DataFrames."""
