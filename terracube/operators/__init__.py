"""Operators on DataFrames of grid cells and time steps."""
