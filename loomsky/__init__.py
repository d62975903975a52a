"""loomsky: calibrating and combining overlapping two-dimensional observations with Spark DataFrames."""
