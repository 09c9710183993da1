"""Operators on coordinate matrices; each takes and returns DataFrames."""
