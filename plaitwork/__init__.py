"""Sequence comparison on Spark: alignment scores, matrices and paths, and anchor chains, over DataFrames."""
