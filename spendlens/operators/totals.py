"""Totals, breakdowns and rankings of ledger lines.

All of them are one partial-then-final aggregation: a hot group arrives at
the shuffle as one row per task. The rankings end in a bounded top-k.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import years_label
from ..functions.measures import signed_sums
from ..spec import LedgerSpec
from .filters import keep_lines

TOP_GROUPS = 30


def yearly_signed(df: DataFrame, spec: LedgerSpec) -> DataFrame:
    """Positive, negative and net total per year, without corrections."""
    amount = F.col(spec.amount)
    return (
        df.filter(keep_lines(spec) & F.col(spec.year).isNotNull())
        .groupBy(F.col(spec.year).alias("year"))
        .agg(*signed_sums(amount), F.sum(amount).alias("net"))
    )


def headline_yearly(df: DataFrame, spec: LedgerSpec) -> DataFrame:
    """``yearly_signed`` for display: labelled, with 0 for no lines."""
    zero = F.lit(0)
    return yearly_signed(df, spec).select(
        "year",
        years_label("year").alias("label"),
        *(F.coalesce(c, zero).alias(c) for c in ("pos", "neg", "net")),
    )


def headline_latest(df: DataFrame, spec: LedgerSpec) -> DataFrame:
    """Latest year and its net total."""
    return (
        yearly_signed(df, spec)
        .agg(F.max("year").alias("year"), F.max_by("net", "year").alias("net"))
        .filter(F.col("year").isNotNull())
    )


def yearly_total(df: DataFrame, spec: LedgerSpec, where: Column | None = None) -> DataFrame:
    """Total per year under a filter (all lines when there is none)."""
    if where is not None:
        df = df.filter(where)
    return df.groupBy(F.col(spec.year).alias("year")).agg(F.sum(spec.amount).alias("total"))


def overall(df: DataFrame, spec: LedgerSpec, where: Column | None = None) -> DataFrame:
    """Count, total, positive and negative total: always one row."""
    if where is not None:
        df = df.filter(where)
    amount = F.col(spec.amount)
    return df.agg(F.count("*").alias("n"), F.sum(amount).alias("total"), *signed_sums(amount))


def page_count(df: DataFrame, where: Column, limit: int) -> DataFrame:
    """Matching lines and the number of pages they fill, at least one."""
    return with_pages(df.filter(where).agg(F.count("*").alias("n")), limit)


def with_pages(counted: DataFrame, limit: int) -> DataFrame:
    pages = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(limit)))
    return counted.withColumn("pages", pages.cast("bigint"))


def _key(group: Column | str) -> Column:
    return F.col(group) if isinstance(group, str) else group


def by_group(df: DataFrame, spec: LedgerSpec, group: Column | str) -> DataFrame:
    """Total and line count per group; NULL is a group of its own."""
    return df.groupBy(_key(group).alias("grp")).agg(
        F.sum(spec.amount).alias("total"), F.count("*").alias("n")
    )


def ranked(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.col("total").desc_nulls_last(), F.col("grp").asc_nulls_first())


def breakdown(
    df: DataFrame,
    spec: LedgerSpec,
    group: Column | str,
    where: Column,
    top: int = TOP_GROUPS,
    missing: str | None = None,
) -> DataFrame:
    """Largest groups by total.

    ``missing`` names the NULL group only after grouping, so a group that
    really carries that name stays a row of its own.
    """
    rows = ranked(by_group(df.filter(where), spec, group)).limit(top)
    if missing is not None:
        rows = rows.withColumn("grp", F.coalesce("grp", F.lit(missing)))
    return rows


def breakdowns(
    df: DataFrame,
    spec: LedgerSpec,
    sections: Mapping[str, Column | str],
    where: Column,
    top: int = TOP_GROUPS,
) -> DataFrame:
    """Several breakdowns from one scan of the ledger.

    Every line enters each section's partial aggregation. The ranking keeps
    the ``top`` groups of a section in each task before they meet, so no task
    receives all groups of a section.
    """
    keys = [F.struct(F.lit(name).alias("section"), _key(c).cast("string").alias("grp"))
            for name, c in sections.items()]
    groups = (
        df.filter(where)
        .select(F.col(spec.amount), F.inline(F.array(*keys)))
        .groupBy("section", "grp")
        .agg(F.sum(spec.amount).alias("total"), F.count("*").alias("n"))
    )
    order = Window.partitionBy("section").orderBy(
        F.col("total").desc_nulls_last(), F.col("grp").asc_nulls_first()
    )
    return (
        groups.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= top).drop("_rank")
    )


def top_groups(
    df: DataFrame, spec: LedgerSpec, group: str, where: Column, top: int = TOP_GROUPS
) -> DataFrame:
    """Groups with the largest absolute total, with signed parts."""
    amount = F.col(spec.amount)
    return (
        df.filter(where)
        .groupBy(F.col(group).alias("grp"))
        .agg(F.sum(amount).alias("total"), F.count("*").alias("n"), *signed_sums(amount))
        .orderBy(F.abs("total").desc_nulls_last(), F.col("grp").asc_nulls_first())
        .limit(top)
    )
