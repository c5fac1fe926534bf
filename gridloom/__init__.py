"""gridloom: energy time-series analytics on Spark DataFrames."""
