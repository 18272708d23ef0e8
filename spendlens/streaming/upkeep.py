"""A year-over-year table that follows its ledger.

Beside the comparison lie the ledger's totals per grain and *part*, a part
being a month of a dated ledger and a year of any other. Totals add up, so a
delivery costs one aggregation of the parts it replaces. Only the years of
these parts, and the ones after them, are compared again, from totals and not
from lines.

Both tables are replaced by whole partitions with content that depends on the
ledger alone. Repeating an update, or one that was cut off, is harmless.

A group all of whose lines are left out keeps a row without lines (``n`` = 0),
so that a part, or a year, that loses its last counted line still replaces what
was stored for it. ``read_comparison`` leaves such rows out.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import keep_lines
from ..operators.yoy import against_year_before
from ..session import shuffles_removed
from ..sources.ledger import open_yoy
from ..sources.sinks import write_yoy
from ..spec import MEASURES, YOY_AMOUNT_TYPE, LedgerSpec
from .deliveries import UNDATED, read_refreshed

PART = "part"
COUNT = "n"
#: Years summed or compared in one job.
YEARS_AT_ONCE = 2


def part_of(spec: LedgerSpec) -> Column:
    """The part a line belongs to; NULL for a line without a date or year."""
    return F.date_format(spec.date, "yyyy-MM") if spec.date else F.col(spec.year).cast("string")


def replace_totals(lines: DataFrame, base: str, spec: LedgerSpec) -> list[int]:
    """Replace the totals of every part in ``lines``, which must be whole; returns their years.

    Lines of a hot group are summed in each task before the shuffle. Lines
    without a year are in no comparison and in no total.
    """
    kept = keep_lines(spec)
    years = sorted(r[0] for r in lines.select(spec.year).distinct().collect() if r[0] is not None)
    for some in _few(years):
        totals = (
            lines.filter(F.col(spec.year).isin(some))
            .groupBy(spec.year, part_of(spec).alias(PART), *spec.grain)
            .agg(
                F.sum(F.when(kept, F.col(spec.amount))).alias(spec.amount),
                F.count_if(kept).alias(COUNT),
            )
        )
        if spec.date:
            # Many months: each task holds some. Of years there are few, and each task writes a file of every one.
            totals = totals.hint("rebalance", F.col(spec.year), F.col(PART))
        with shuffles_removed(lines.sparkSession):
            (
                totals.write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(spec.year, PART)
                .parquet(f"{base}/totals")
            )
    return years


def _few(years: list[int]) -> list[list[int]]:
    return [years[i : i + YEARS_AT_ONCE] for i in range(0, len(years), YEARS_AT_ONCE)]


def compare_again(spark: SparkSession, base: str, years: Collection[int], spec: LedgerSpec) -> None:
    """Compare these years and the ones after them anew, from the totals."""
    stored = spark.read.parquet(f"{base}/totals") if years else None
    year = F.col(spec.year)
    for stale in _few(sorted({y + step for y in years for step in (0, 1)})):
        yearly = (
            stored.filter(year.isin(sorted({*stale, *(y - 1 for y in stale)})))
            # Dealt once for the sums and for the comparison; a group has few parts a year.
            .repartition(*spec.grain)
            .groupBy(*spec.grain, spec.year)
            .agg(
                F.sum(spec.amount).cast(YOY_AMOUNT_TYPE).alias("actual_real"),
                F.sum(COUNT).alias(COUNT),
            )
        )
        compared = against_year_before(yearly, spec).filter(year.isin(stale))
        columns = (spec.year, *spec.grain, *MEASURES, COUNT)
        with shuffles_removed(spark):
            write_yoy(compared.select(*columns), f"{base}/comparison", spec, replace_all=False)


def update_comparison(lines: DataFrame, base: str, spec: LedgerSpec) -> None:
    """Bring the comparison at ``base`` up to date with parts that were replaced.

    ``lines`` are all lines these parts have now. A part that has lost every
    line is not noticed; deliveries never leave one empty.
    """
    compare_again(lines.sparkSession, base, replace_totals(lines, base, spec), spec)


def follow_months(
    spark: SparkSession, target: str, base: str, months: Iterable[str], spec: LedgerSpec
) -> None:
    """Update the comparison after ``refresh`` has replaced months of the ledger at ``target``.

    Only the folders of these months are read.
    """
    changed = sorted(m for m in months if m != UNDATED)
    if changed:
        stored = read_refreshed(spark, target, spec, changed)
        update_comparison(stored.withColumn(spec.year, F.year(spec.date)), base, spec)


def read_comparison(spark: SparkSession, base: str, spec: LedgerSpec) -> DataFrame | None:
    """The comparison as ``year_over_year`` gives it; None before the first update."""
    stored = open_yoy(spark, f"{base}/comparison", spec)
    if stored is None:
        return None
    return stored.filter(F.col(COUNT) > 0).select(spec.year, *spec.grain, *MEASURES)
