"""Authorization-logic analytics over source code, as Spark DataFrames."""
