"""Form digitization analytics on Spark DataFrames."""
