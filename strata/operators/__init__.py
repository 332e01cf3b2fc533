"""Operators over DataFrames; each takes and returns DataFrames."""
