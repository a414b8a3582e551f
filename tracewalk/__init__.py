"""Governed questions over typed property graphs, answered with Spark DataFrames."""
