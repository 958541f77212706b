"""Text search, citation and bibliography analytics on Spark DataFrames."""
