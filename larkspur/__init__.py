"""larkspur: text, search and knowledge-graph analytics on Spark DataFrames."""
