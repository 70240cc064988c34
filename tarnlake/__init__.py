"""Document retrieval and evaluation on Spark DataFrames."""
