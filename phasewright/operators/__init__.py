"""Operators from DataFrame to DataFrame; column names are parameters."""
