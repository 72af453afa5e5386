"""Training-data operators: each takes DataFrames and returns DataFrames."""
