"""Operators over ledgers: DataFrame in, DataFrame out."""
