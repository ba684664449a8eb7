"""caseflow: case-tracking analytics on Spark DataFrames."""
