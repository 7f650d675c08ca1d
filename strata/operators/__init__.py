"""The data plane: pure functions from DataFrames to DataFrames."""
