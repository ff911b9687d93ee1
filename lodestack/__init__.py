"""lodestack: document, graph and operations analytics on Spark DataFrames."""
