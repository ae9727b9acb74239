"""Steps that take DataFrames and return a DataFrame."""
