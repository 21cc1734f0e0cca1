"""lodeweave: graph-and-text analytics over DataFrames, built on Spark SQL."""
