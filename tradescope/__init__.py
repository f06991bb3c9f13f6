"""Trade-risk analytics on Spark: DataFrames in, DataFrames out."""
