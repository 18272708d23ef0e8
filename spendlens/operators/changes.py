"""Change against the previous year that has lines (gaps are skipped)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import pct_change
from ..spec import LedgerSpec
from .filters import keep_lines
from .totals import yearly_total


def selected_change(df: DataFrame, spec: LedgerSpec, where: Column) -> DataFrame:
    """Yearly totals under a filter with the change to the year before.

    The window has no partitions, over an input of one row per year.
    """
    w = Window.orderBy(F.col("year").asc_nulls_last())
    yearly = yearly_total(df, spec, where)
    return yearly.withColumn("_before", F.lag("total").over(w)).select(
        "year", "total", pct_change(F.col("total"), F.col("_before")).alias("change_pct")
    )


def average_change(
    df: DataFrame, spec: LedgerSpec, group: str, show_corrections: bool = False
) -> DataFrame:
    """Mean change of the groups, per year.

    The window runs over (group, year) totals, so a partition holds as many
    rows as there are years however many lines the group has.
    """
    w = Window.partitionBy("g").orderBy(F.col("year").asc_nulls_last())
    totals = (
        df.filter(F.col(group).isNotNull() & keep_lines(spec, show_corrections))
        .groupBy(F.col(group).alias("g"), F.col(spec.year).alias("year"))
        .agg(F.sum(spec.amount).alias("s"))
    )
    changes = totals.withColumn("_before", F.lag("s").over(w)).select(
        "year", pct_change(F.col("s"), F.col("_before")).alias("change_pct")
    )
    return (
        changes.filter(F.col("change_pct").isNotNull())
        .groupBy("year")
        .agg(F.avg("change_pct").alias("avg_change_pct"))
    )


def change_against_average(
    df: DataFrame, spec: LedgerSpec, group: str, where: Column, show_corrections: bool = False
) -> DataFrame:
    """The selected series next to the average one, years without NULL."""
    selected = selected_change(df, spec, where).filter(F.col("year").isNotNull())
    average = average_change(df, spec, group, show_corrections)
    return selected.join(average, "year", "left").select(
        "year",
        F.coalesce("total", F.lit(0)).alias("total"),
        "change_pct",
        "avg_change_pct",
        (F.col("change_pct") - F.col("avg_change_pct")).alias("diff_pct"),
    )
