"""Exact Hamming similarity joins and training-data operators on Spark DataFrames."""
