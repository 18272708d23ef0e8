"""Complete, unlimited groupings of one dimension, one level at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.supplier import UNREGISTERED
from ..spec import LedgerSpec
from .filters import keep_lines, year_is
from .totals import by_group, ranked


def scope(df: DataFrame, spec: LedgerSpec, year: object = "all") -> DataFrame:
    return df.filter(keep_lines(spec) & year_is(spec, year))


def drill_types(df: DataFrame, spec: LedgerSpec, year: object = "all") -> DataFrame:
    return ranked(by_group(scope(df, spec, year), spec, spec.type))


def drill_sellers(df: DataFrame, spec: LedgerSpec, year: object = "all") -> DataFrame:
    return ranked(by_group(scope(df, spec, year), spec, spec.seller))


def drill_type_buyers(df: DataFrame, spec: LedgerSpec, value: str, year: object = "all") -> DataFrame:
    """Buyers of one type. A city leaves out lines without a unit."""
    lines = scope(df, spec, year).filter(F.col(spec.type) == F.lit(value))
    if not spec.seller_column:
        lines = lines.filter(F.col(spec.buyer).isNotNull())
    return ranked(by_group(lines, spec, spec.buyer))


def drill_seller_buyers(df: DataFrame, spec: LedgerSpec, value: str, year: object = "all") -> DataFrame:
    lines = scope(df, spec, year).filter(spec.seller == F.lit(value))
    return ranked(by_group(lines, spec, spec.buyer))


def drill_seller_adaptive(df: DataFrame, spec: LedgerSpec, value: str, year: object = "all") -> DataFrame:
    """One city supplier by expense code if it has any, else by unit.

    Both groupings come from one aggregation of its lines. Which one is shown
    is decided among the groups of this one supplier, of which there are as
    many as it has codes and units.
    """
    code, text, unit = "expense_code", "expense_label", spec.buyer
    lines = scope(df, spec, year).filter(spec.seller == F.lit(value))
    both = lines.groupingSets([[code, text], [unit]], code, text, unit).agg(
        F.sum(spec.amount).alias("total"),
        F.count("*").alias("n"),
        F.grouping(unit).alias("coded"),
    )
    has_codes = F.max((F.col("coded") == 1) & F.col(code).isNotNull()).over(Window.partitionBy())
    shown = both.withColumn("has_codes", has_codes).filter((F.col("coded") == 1) == F.col("has_codes"))
    label = F.when(F.col("coded") == 1, F.coalesce(text, code)).otherwise(F.col(unit))
    return shown.orderBy(
        F.col("total").desc_nulls_last(), *(F.col(k).asc_nulls_first() for k in (code, text, unit))
    ).select(F.coalesce(label, F.lit(UNREGISTERED)).alias("grp"), "total", "n")
