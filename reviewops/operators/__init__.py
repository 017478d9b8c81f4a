"""Operators: functions from DataFrame to DataFrame, for all hotels at once."""
