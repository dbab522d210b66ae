"""Operators: DataFrame to DataFrame transforms."""
