"""Training-corpus analytics on Spark DataFrames."""
