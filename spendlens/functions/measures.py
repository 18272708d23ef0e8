"""Arithmetic shared by totals and comparisons.

Amounts stay decimals so that a sum does not depend on task order; only
ratios become doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_pct(change: Column, base: Column) -> Column:
    """``change`` in percent of ``|base|``; NULL when base is NULL or 0."""
    size = F.nullif(F.abs(base).cast("double"), F.lit(0.0))
    return change.cast("double") / size * F.lit(100.0)


def pct_change(current: Column, previous: Column) -> Column:
    return safe_pct(current - previous, previous)


def signed_sums(amount: Column) -> list[Column]:
    """Positive and negative totals; NULL when no such line exists."""
    return [
        F.sum(F.when(amount > 0, amount)).alias("pos"),
        F.sum(F.when(amount < 0, amount)).alias("neg"),
    ]
