"""pipelark: pipeline queries over time-stamped tables, compiled to Spark DataFrames."""
