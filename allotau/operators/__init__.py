"""Operators on matrices: DataFrame in, DataFrame out, all keyed by dataset."""
