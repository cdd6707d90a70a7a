"""Index-aligned time-series programs on Spark DataFrames."""
