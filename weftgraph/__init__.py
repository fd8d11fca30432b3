"""Graph, vector and text analytics on Spark DataFrames."""
