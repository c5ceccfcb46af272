"""Record-pipeline operators on Spark DataFrames."""
