"""A code-intelligence fact engine on Spark DataFrames."""
