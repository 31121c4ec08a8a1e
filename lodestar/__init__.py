"""Lodestar: case-and-docket analytics built on Spark DataFrames."""
