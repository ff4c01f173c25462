"""Walk-forward panel analytics on Spark DataFrames."""
