"""Change against the previous calendar year, on the full grain."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import safe_pct
from ..spec import MEASURES, YOY_AMOUNT_TYPE, LedgerSpec
from .filters import keep_lines, year_in


def year_over_year(
    df: DataFrame, spec: LedgerSpec, only: Iterable[int] | None = None
) -> DataFrame:
    """One row per (grain, year) with the amount of the year before.

    A missing year before counts as 0 and leaves the percentage NULL; a group
    that vanishes gets no row. NULL is a value like any other in the grain.

    The year before is found by ``lag`` plus a check that it is adjacent,
    which needs one sort where a null-safe self join on the whole grain needs
    two. Lines of a hot group are summed before the shuffle, and a window
    partition holds at most one row per year.

    ``only`` limits the result to some years, to bring a stored table up to
    date or to look at one year; then just those years and the ones before
    are read.
    """
    year = F.col(spec.year)
    lines = df.filter(keep_lines(spec) & year.isNotNull())
    if only is not None:
        wanted = sorted(only)
        lines = lines.filter(year_in(spec, sorted({*wanted, *(y - 1 for y in wanted)})))
    yearly = (
        lines
        .groupBy(*spec.grain, spec.year)
        .agg(F.sum(spec.amount).alias("actual_real"))
    )
    table = against_year_before(yearly, spec).select(spec.year, *spec.grain, *MEASURES)
    return table if only is None else table.filter(year.isin(wanted))


def against_year_before(yearly: DataFrame, spec: LedgerSpec) -> DataFrame:
    """Adds the comparison to yearly totals, one row per (grain, year); other columns stay."""
    w = Window.partitionBy(*spec.grain).orderBy(spec.year)
    adjacent = F.lag(spec.year).over(w) == F.col(spec.year) - 1
    before = F.when(adjacent, F.lag("actual_real").over(w))
    change = F.col("actual_real") - F.col("prior_real")
    return (
        yearly.withColumn("prior_real", F.coalesce(before, F.lit(0)).cast(YOY_AMOUNT_TYPE))
        .withColumn("yoy_real_change", change.cast(YOY_AMOUNT_TYPE))
        .withColumn("yoy_real_pct", safe_pct(F.col("yoy_real_change"), F.col("prior_real")))
    )


def is_anomaly(min_pct: float = 20.0, min_amount: float = 50e6) -> Column:
    """A change that is large in money or in percent."""
    return (F.abs("yoy_real_change") >= F.lit(min_amount)) | (
        F.abs(F.coalesce("yoy_real_pct", F.lit(0.0))) >= F.lit(min_pct)
    )


def flag_anomalies(yoy: DataFrame, min_pct: float = 20.0, min_amount: float = 50e6) -> DataFrame:
    return yoy.filter(is_anomaly(min_pct, min_amount))
