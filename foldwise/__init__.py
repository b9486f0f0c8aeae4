"""Fold-sealed audit analytics on Spark DataFrames."""
