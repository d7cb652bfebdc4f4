"""molframe: molecule-tagged read analytics on Spark DataFrames."""
