"""Event correlation and analytics on Spark DataFrames."""
