"""axisflow: tabular staging, axis-wise tensor operators and boosted trees on Spark DataFrames."""
