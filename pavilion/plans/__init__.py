"""Query specifications and their compilation to DataFrames."""
