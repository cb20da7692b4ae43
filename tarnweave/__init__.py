"""tarnweave: link analysis and text search on Spark DataFrames."""
