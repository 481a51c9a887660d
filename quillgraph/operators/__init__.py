"""Operators: DataFrame to DataFrame, lazy, keyed on ids."""
