"""Operators that take and return DataFrames or Columns."""
