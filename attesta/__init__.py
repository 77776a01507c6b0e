"""Identity-verification analytics on Spark DataFrames."""
