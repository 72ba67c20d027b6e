"""DataFrame operators: each takes DataFrames and parameters and returns a lazy DataFrame."""
