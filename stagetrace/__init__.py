"""Linking two-stage inference results with Spark DataFrames."""
