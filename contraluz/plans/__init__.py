"""The jobs: each function takes DataFrames and returns a DataFrame."""
