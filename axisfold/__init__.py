"""axisfold: scoring of multi-dimensional measurement data on Spark DataFrames."""
