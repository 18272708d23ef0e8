"""Exploring a year-over-year table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import pct_change, safe_pct
from ..spec import LedgerSpec
from .filters import keep_lines, match_all, year_is


def by_group_and_year(yoy: DataFrame, group: str, where: Column) -> DataFrame:
    return (
        yoy.filter(where & F.col(group).isNotNull())
        .groupBy(F.col(group).alias("grp"), "year")
        .agg(*(F.sum(c).alias(c) for c in ("actual_real", "prior_real", "yoy_real_change")))
        .withColumn("pct", safe_pct(F.col("yoy_real_change"), F.col("prior_real")))
    )


def anomaly_score(yoy: DataFrame, group: str, where: Column, top: int = 15) -> DataFrame:
    """Groups ranked by the sum of absolute yearly changes.

    Changes are summed per (group, year) first, then per group.
    """
    return (
        by_group_and_year(yoy, group, where)
        .groupBy("grp")
        .agg(
            F.count("*").alias("years_flagged"),
            F.sum(F.abs("yoy_real_change")).alias("abs_change_sum"),
            F.max(F.abs("pct")).alias("max_abs_pct"),
        )
        .withColumn(
            "avg_change_amount",
            F.col("abs_change_sum").cast("double") / F.col("years_flagged").cast("double"),
        )
        .orderBy(F.col("abs_change_sum").desc_nulls_last(), F.col("grp").asc())
        .limit(top)
    )


def anomaly_detail(yoy: DataFrame, group: str, where: Column, limit: int = 50) -> DataFrame:
    """(Group, year) rows with the largest relative change."""
    year, change = F.col("year"), F.col("yoy_real_change")
    return (
        by_group_and_year(yoy, group, where)
        .orderBy(F.abs("pct").desc_nulls_last(), F.col("grp").asc(), year.desc_nulls_last())
        .limit(limit)
        .select(
            "grp",
            "year",
            F.coalesce(
                F.concat((year - 1).cast("string"), F.lit(" → "), year.cast("string")), F.lit("–")
            ).alias("period"),
            "actual_real",
            "prior_real",
            "yoy_real_change",
            "pct",
            F.when(F.coalesce(change, F.lit(0)) >= 0, "up").otherwise("down").alias("direction"),
        )
    )


def anomaly_years_per_group(yoy: DataFrame, group: str, where: Column) -> DataFrame:
    return (
        yoy.filter(where & F.col(group).isNotNull())
        .groupBy(F.col(group).alias("grp"))
        .agg(F.countDistinct("year").alias("anomaly_years"))
    )


def anomaly_context(
    ledger: DataFrame,
    yoy: DataFrame,
    spec: LedgerSpec,
    focus: tuple[str, str],
    value: str,
    where: Column,
    year: object = "all",
    within: str = "all",
    top: int = 30,
) -> DataFrame:
    """Spending of the focus value by driver, with its anomaly years.

    The ledger is cut to the top rows before the counts are attached, so the
    join has at most ``top`` rows on its left.
    """
    focus_col, driver = focus
    mine = F.col(focus_col) == F.lit(value)
    spent = (
        ledger.filter(
            mine & keep_lines(spec) & year_is(spec, year) & F.col(driver).isNotNull()
        )
        .groupBy(F.col(driver).alias("grp"))
        .agg(
            F.sum(spec.amount).alias("total_amount"),
            F.countDistinct(spec.year).alias("years_with_spend"),
        )
        .orderBy(F.abs("total_amount").desc_nulls_last(), F.col("grp").asc())
        .limit(top)
    )
    counts = anomaly_years_per_group(yoy, driver, where & mine)
    return spent.join(counts, "grp", "left").select(
        "grp",
        "total_amount",
        "years_with_spend",
        F.coalesce("anomaly_years", F.lit(0)).alias("anomaly_years"),
        (F.col("grp") == F.lit(within) if within != "all" else F.lit(False)).alias("is_selected"),
    )


def anomaly_year_series(
    ledger: DataFrame | None,
    yoy: DataFrame,
    spec: LedgerSpec,
    where_yoy: Column,
    pairs: list[tuple[str, object]] | None = None,
) -> DataFrame:
    """Every year of the ledger with its total, change and anomaly mark.

    A year without matching lines counts 0, and the year after it has no
    percentage. Year domain and totals come from one scan. Without a ledger
    the years come from the comparison itself and all totals are 0.
    """
    pairs = pairs or []
    mine = match_all(pairs)
    if ledger is not None:
        matching = F.when(keep_lines(spec) & mine, F.col(spec.amount))
        yearly = (
            ledger.filter(F.col(spec.year).isNotNull())
            .groupBy(F.col(spec.year).alias("year"))
            .agg(F.coalesce(F.sum(matching), F.lit(0)).alias("total"))
        )
    else:
        yearly = (
            yoy.select("year").filter(F.col("year").isNotNull()).distinct()
            .withColumn("total", F.lit(0).cast("decimal(28,2)"))
        )
    flagged = yoy.filter(where_yoy & mine).select("year").distinct().withColumn("_hit", F.lit(True))
    w = Window.orderBy("year")
    return (
        yearly.withColumn("_before", F.lag("total").over(w))
        .withColumn("change_pct", pct_change(F.col("total"), F.col("_before")))
        .join(flagged, "year", "left")
        .select(
            "year", "total", "change_pct", F.coalesce("_hit", F.lit(False)).alias("is_anomaly")
        )
    )
