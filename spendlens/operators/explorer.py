"""All lists of an explorer page from one scan of the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import signed_sums
from ..spec import YOY_AMOUNT_TYPE, LedgerSpec
from .filters import Selection, year_is
from .totals import TOP_GROUPS

#: Parts in which the groups of a ranked section are cut down before they meet.
PARTS = 256
TOTALS = "totals"


def explorer_sections(
    ledger: DataFrame, spec: LedgerSpec, selection: Selection, top: int = TOP_GROUPS
) -> DataFrame:
    """(section, grp, n, total, pos, neg): what the page shows beside its lines.

    * ``year_options``, ``type_options``, ``buyer_options``, ``unit_options``
      (only without a seller column): values that occur, NULL not among them,
      whatever is selected.
    * ``yearly``: totals per year under the selection but its year.
    * ``type``, ``buyer``, ``seller``: the ``top`` groups by total under the
      selection; NULL is a group like any other.
    * ``totals``: always one row, also when nothing is selected.

    Lines are first summed to cells by year, type, buyer, unit and seller, and
    only the cells enter the sections. Groups are ranked within parts of a
    section and then among the best of all parts, so that no task sees all
    groups of a section; options are not ranked and never gathered.
    """
    year, amount = F.col(spec.year), F.col(spec.amount)
    keys = {"year": year, "type": F.col(spec.type), "buyer": F.col(spec.buyer), "seller": spec.seller}
    if not spec.seller_column:
        keys["unit"] = F.col(spec.buyers[1])
    chosen = F.coalesce(selection.predicate(spec, with_year=False), F.lit(False))
    cells = (
        ledger.select(
            *(c.alias(f"_{k}") for k, c in keys.items()),
            amount.alias("_amount"),
            chosen.alias("_chosen"),
            (chosen & F.coalesce(year_is(spec, selection.year), F.lit(False))).alias("_now"),
        )
        .groupBy(*(f"_{k}" for k in keys), "_chosen", "_now")
        .agg(F.count("*").alias("n"), F.sum("_amount").alias("total"), *signed_sums(F.col("_amount")))
    )
    now, ranked = F.col("_now"), ["type", "buyer", "seller"]
    sections: list[tuple[str, Column, Column]] = [
        (f"{k}_options", F.col(f"_{k}"), F.col(f"_{k}").isNotNull()) for k in keys if k != "seller"
    ]
    sections.append(("yearly", F.col("_year"), F.col("_chosen")))
    sections += [(k, F.col(f"_{k}"), now) for k in ranked]
    sections.append((TOTALS, F.lit(None), now))
    entries = F.array_compact(
        F.array(
            *(
                F.when(shown, F.struct(F.lit(name).alias("section"), value.cast("string").alias("grp")))
                for name, value, shown in sections
            )
        )
    )
    sums = ("total", "pos", "neg")
    spread = cells.select("n", *sums, F.inline(entries))
    nothing = ledger.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("n"),
        *(F.lit(None).cast(YOY_AMOUNT_TYPE).alias(c) for c in sums),
        F.lit(TOTALS).alias("section"),
        F.lit(None).cast("string").alias("grp"),
    )
    groups = (
        spread.unionByName(nothing)
        .groupBy("section", "grp")
        .agg(F.sum("n").alias("n"), *(F.sum(c).cast(YOY_AMOUNT_TYPE).alias(c) for c in sums))
    )
    best = (F.col("total").desc_nulls_last(), F.col("grp").asc_nulls_first())
    listed = ~F.col("section").isin(ranked)
    within = Window.partitionBy("section", F.pmod(F.xxhash64("grp"), F.lit(PARTS))).orderBy(*best)
    # A listed row is alone in its partition.
    overall = Window.partitionBy("section", F.when(listed, F.struct("grp"))).orderBy(*best)
    for window in (within, overall):
        groups = groups.withColumn("_rank", F.row_number().over(window))
        groups = groups.filter(listed | (F.col("_rank") <= top)).drop("_rank")
    if spec.type_fallback:
        unnamed = (F.col("section") == "type") & F.col("grp").isNull()
        groups = groups.withColumn("grp", F.when(unnamed, F.lit(spec.type_fallback)).otherwise(F.col("grp")))
    return groups.select("section", "grp", "n", *sums)
