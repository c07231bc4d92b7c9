"""Scalar functions as SQL expressions that Spark and DuckDB both read."""
