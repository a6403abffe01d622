"""Operators on DataFrames of ring tracks."""
