"""matloom: statistics over dense numeric matrices, expressed as Spark DataFrames."""
