"""Parquet sinks.

Partitioned writes ask for a rebalance on the partition columns: AQE gathers
small partitions into one file and splits a hot one over several tasks, so a
year holding a third of all lines does not end up in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import LedgerSpec


def write_table(df: DataFrame, path: str, compression: str = "snappy") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def write_by_year(
    df: DataFrame, path: str, spec: LedgerSpec, keep_layout: bool = False
) -> None:
    """A whole ledger, one folder per year.

    ``keep_layout`` saves the shuffle when the lines come from a table that is
    stored by year already: each task then holds lines of one year.
    """
    (
        (df if keep_layout else df.hint("rebalance", F.col(spec.year)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(spec.year)
        .parquet(path)
    )


def write_by_month(
    df: DataFrame, path: str, date: str = "paid_on", undated: str | None = None
) -> None:
    """Replace exactly the months present in ``df``; others stay.

    Replacing whole partitions makes a repeated or retried delivery harmless.
    ``undated`` names the folder of lines without a date.
    """
    (
        df.withColumn("month", F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(undated)))
        .hint("rebalance", F.col("month"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(path)
    )


def yoy_order(spec: LedgerSpec) -> tuple[Column, ...]:
    return (
        F.col(spec.year).desc_nulls_last(),
        F.abs("yoy_real_change").desc_nulls_last(),
        *(F.col(c).asc_nulls_first() for c in spec.grain),
    )


def write_yoy(yoy: DataFrame, path: str, spec: LedgerSpec, replace_all: bool = True) -> None:
    """A year-over-year table, newest year and largest change first.

    Range partitioning on year and size of change gives many ordered files
    per year without one task per year. Without ``replace_all`` only the years
    present in ``yoy`` are replaced.
    """
    order = yoy_order(spec)
    (
        yoy.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if replace_all else "dynamic")
        .partitionBy(spec.year)
        .parquet(path)
    )
