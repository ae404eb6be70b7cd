"""Operators: functions from DataFrames to DataFrames, nothing collected inside."""
