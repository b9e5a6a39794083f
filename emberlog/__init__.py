"""emberlog: log analytics on Spark DataFrames."""
