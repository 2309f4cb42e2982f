"""leadflow: evidence-based entity discovery and record processing on Spark DataFrames."""
