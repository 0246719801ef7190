"""Station and grid analytics on Spark DataFrames."""
