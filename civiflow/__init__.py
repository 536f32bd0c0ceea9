"""Service-request analytics on Spark DataFrames."""
