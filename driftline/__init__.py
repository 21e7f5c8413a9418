"""driftline: change-impact analytics on Spark DataFrames."""
