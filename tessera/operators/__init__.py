"""The analytical operators: functions from DataFrames to a DataFrame."""
