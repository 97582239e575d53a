"""Operators: functions from DataFrames to DataFrames, keyed so that many items run at once."""
