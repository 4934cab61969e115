"""rangegrid: conjunctive range scans over rank-encoded, grid-indexed columns, on Spark DataFrames."""
