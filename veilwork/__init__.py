"""Document de-identification and data preparation on Spark DataFrames."""
