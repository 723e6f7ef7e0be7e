"""Operators: functions from DataFrames to DataFrames, over named columns of any table."""
