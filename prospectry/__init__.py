"""Business-listing lead analytics on Spark DataFrames."""
