"""Message-archive analytics on Spark DataFrames."""
