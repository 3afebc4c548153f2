"""Operators on DataFrames of vectors, shingles and points."""
