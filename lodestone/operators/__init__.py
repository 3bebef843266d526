"""Operators: DataFrames in, DataFrames out, nothing collected."""
