"""Two last years side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import pct_change
from ..spec import LedgerSpec
from .filters import year_is, years


def last_two_years(df: DataFrame, spec: LedgerSpec) -> list[int]:
    """The two newest years. Two numbers for the driver, nothing more: as
    literals they prune partitions of the scan that follows."""
    return [r[0] for r in years(df, spec).limit(2).collect()]


def two_year_change(
    df: DataFrame, spec: LedgerSpec, group: str, top: int = 20, pair: list[int] | None = None
) -> DataFrame:
    """Groups present in both last years, largest absolute change first.

    One scan and one aggregation hold both years; a group that misses a year
    or has no name drops out, as an inner join of the two would do. A change
    of nothing goes up.
    """
    pair = last_two_years(df, spec) if pair is None else pair
    if len(pair) < 2:
        pair = [0, 0]
    amount = F.col(spec.amount)
    cur, prev = (F.col(spec.year) == y for y in pair)
    both = df.filter(
        (year_is(spec, pair[0]) | year_is(spec, pair[1])) & cur.eqNullSafe(~prev)
    ).filter(F.col(group).isNotNull())
    sums = (
        both.groupBy(F.col(group).alias("grp"))
        .agg(
            F.sum(F.when(cur, amount)).alias("cur"),
            F.sum(F.when(prev, amount)).alias("prev"),
            F.count(F.when(cur, 1)).alias("_n_cur"),
            F.count(F.when(prev, 1)).alias("_n_prev"),
        )
        .filter((F.col("_n_cur") > 0) & (F.col("_n_prev") > 0))
    )
    return (
        sums.withColumn("change", F.col("cur") - F.col("prev"))
        .select(
            "grp",
            "cur",
            "prev",
            "change",
            pct_change(F.col("cur"), F.col("prev")).alias("pct"),
            F.when(F.coalesce(F.col("change"), F.lit(0)) >= 0, "up").otherwise("down").alias("direction"),
            F.lit(pair[1]).alias("prev_year"),
            F.lit(pair[0]).alias("cur_year"),
        )
        .orderBy(F.abs("change").desc_nulls_last(), F.col("grp").asc())
        .limit(top)
    )
