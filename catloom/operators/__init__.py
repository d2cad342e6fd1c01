"""Operators: functions from DataFrames to DataFrames, without I/O."""
