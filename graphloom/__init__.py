"""Graph, text, vector and history analytics on Spark DataFrames."""
