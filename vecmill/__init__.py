"""vecmill: vector clustering and corpus preparation on Spark DataFrames."""
