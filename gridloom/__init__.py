"""Dense-array analytics on Spark DataFrames."""
