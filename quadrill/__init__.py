"""Combined vector, spatial and label search on Spark DataFrames."""
