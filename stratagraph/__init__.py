"""Graph-grounded text and code analytics on Spark DataFrames."""
