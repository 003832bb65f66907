"""Training-data operators: ten independent modules over plain DataFrames."""
