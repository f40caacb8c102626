"""Claims-integrity analytics on Spark DataFrames."""
