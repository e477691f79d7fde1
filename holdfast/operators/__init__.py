"""Operators: functions from DataFrames to a DataFrame, lazy and free of driver loops over rows."""
