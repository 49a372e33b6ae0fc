"""Rule refinement on Spark DataFrames."""
