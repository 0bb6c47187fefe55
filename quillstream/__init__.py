"""A flat, streaming-minded SQL dialect compiled to Spark DataFrames."""
