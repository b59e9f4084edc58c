"""Graph analytics over DataFrames."""
