"""Operators for preparing training data: one module per operator.

Nothing else in the library imports this package. ``registry`` holds its
registered queries.
"""
