"""Street-network and elevation-route analytics on Spark DataFrames."""
