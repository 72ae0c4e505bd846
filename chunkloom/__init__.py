"""Content-addressed storage analytics as Spark DataFrames."""
