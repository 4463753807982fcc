"""quarry: hybrid-retrieval analytics on Spark DataFrames."""
