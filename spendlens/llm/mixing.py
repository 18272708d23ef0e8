"""Mixing sources to target weights.

A source whose target exceeds its size is repeated in whole epochs; what is
left of the target is a weighted sample without replacement: each document
draws an exponential key, divided by its quality weight, and the documents
with the smallest keys are taken until their sizes reach the rest
(Efraimidis and Spirakis).

Sorting a source does not gather it in one task. Sizes are first summed by
slices of the key range; they tell the slice in which the budget ends, and
only rows of that slice are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import keep, small
from .text import unit

#: Slices of a source's key range.
SLICES = 4096
#: No document is taken more often, counting a last partial epoch.
MOST_EPOCHS = 3


def source_targets(sizes: DataFrame, shares: Column, most: int = MOST_EPOCHS) -> DataFrame:
    """Target of each source: its share of all sizes, ``most`` times its own size at most.

    ``sizes``: a row per source (source, source_size). ``shares`` is an
    expression over ``nth`` (from 1: the rank of the source by code point,
    null last). What a limit cuts off goes to the other sources by weight, as
    often as needed: sorted by size over weight, the limited sources are the
    first ones, so a running sum finds them in one pass.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("nth", F.row_number().over(by_name)).withColumn(
        "weight", shares.cast("double")
    )
    # The first sources in this order reach their limit first, whatever is reshared.
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "nth")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    filled = (
        ranked.withColumn("all", F.sum("source_size").over(all_))
        .withColumn("held", F.coalesce(F.sum("source_size").over(earlier), F.lit(0)) * most)
        .withColumn(
            "left_weight",
            F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        )
        # Per unit of weight, if exactly the sources before this one are limited.
        .withColumn("level", (F.col("all") - F.col("held")) / F.col("left_weight"))
        .withColumn("open", F.col("level") * F.col("weight") <= most * F.col("source_size"))
        .withColumn(
            "first_open",
            F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
                order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        )
    )
    limit = (F.col("source_size") * most).cast("double")
    return filled.select(
        *sizes.columns,
        F.coalesce(F.least(F.col("first_open") * F.col("weight"), limit), limit).alias("target"),
    )


def mix(
    docs: DataFrame,
    size: Column,
    weight: Column,
    shares: Column,
    identity: list[str],
) -> DataFrame:
    """All rows and columns of ``docs`` plus ``mix``, which tells how often to take a row.

    ``mix`` is a struct of size, source_size, target, copies and taken (copies
    times size). Every row is returned, also those with no copy.

    * Columns: a column of ``docs`` named ``mix`` is replaced, all others stay.
    * Null source: a source of its own. Null size counts 0; such rows are taken
      once per epoch and cost nothing.
    * Weights that are null or not above 0 count as 2**-1000.
    * The draw depends on ``identity`` alone, so reruns agree; rows equal in it
      share their draw and are taken together.
    * The row at the end of a budget is taken if that brings the sum nearer to
      the target, so a source misses it by half a row (or group of equal rows)
      at most.
    * An empty table gives an empty table.
    """
    smallest = F.lit(2.0**-1000)
    rate = F.when(weight > smallest, weight.cast("double")).otherwise(smallest)
    rows = docs.select(
        F.struct(*(docs[c] for c in docs.columns if c != "mix")).alias("row"),
        F.col("source").alias("source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        (-F.log(unit(*(F.col(c) for c in identity))) / rate).alias("key"),
        rate.alias("rate"),
    )
    bounds = _bounds(keep(rows.drop("row"), "mix"), shares)
    # Rises with the key, and is spread evenly if the weights of a source are equal.
    picked = _with_bounds(rows, bounds).withColumn(
        "copies",
        F.col("epochs")
        + F.when(F.col("rest") <= 0, 0)
        .when(F.col("last").isNull() | (F.col("slice") < F.col("last")), 1)
        .when(F.col("key") <= F.col("end_key"), 1)
        .otherwise(0),
    )
    return picked.select(
        "row.*",
        F.struct(
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        ).alias("mix"),
    )


def _with_bounds(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    slice_ = F.floor((1 - F.exp(-F.col("key") * F.col("mean_rate"))) * SLICES)
    return rows.join(
        small(bounds), F.col("source").eqNullSafe(F.col("of"))
    ).withColumn("slice", slice_)


def _bounds(drawn: DataFrame, shares: Column) -> DataFrame:
    """A row per source: epochs, and the key at which its fractional epoch ends."""
    sources = keep(
        drawn.groupBy("source").agg(
            F.sum("size").alias("source_size"), F.avg("rate").alias("mean_rate")
        ),
        "mix-sources",
    )
    epochs = F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    plan = (
        source_targets(sources, shares)
        .withColumn("epochs", F.least(F.coalesce(epochs, F.lit(0)), F.lit(MOST_EPOCHS)))
        .withColumn(
            "rest",
            F.when(
                F.col("epochs") < MOST_EPOCHS,
                F.col("target") - F.col("epochs") * F.col("source_size"),
            ).otherwise(0.0),
        )
        .withColumnRenamed("source", "of")
    )
    plan = keep(plan, "mix-plan")
    rows = _with_bounds(drawn, plan)
    sums = (
        rows.groupBy("source", "slice", "rest")
        .agg(F.sum("size").alias("sum"))
        .withColumn("upto", F.sum("sum").over(Window.partitionBy("source").orderBy("slice")))
    )
    # The slice in which the budget ends, and the sum before it.
    last = (
        sums.filter((F.col("upto") >= F.col("rest")) & (F.col("rest") > 0))
        .groupBy("source")
        .agg(F.min(F.struct("slice", (F.col("upto") - F.col("sum")).alias("before"))).alias("at"))
        .select(
            F.col("source").alias("last_of"),
            F.col("at.slice").alias("last"),
            F.col("at.before").alias("before"),
        )
    )
    last = keep(last, "mix-last")
    same_source = F.col("source").eqNullSafe(F.col("last_of"))
    ends = (
        rows.join(small(last), same_source & (F.col("slice") == F.col("last")))
        .groupBy("source", "key", "rest", "before")  # rows with one key are one step
        .agg(F.sum("size").alias("step"))
        .withColumn("sum", F.sum("step").over(Window.partitionBy("source").orderBy("key")))
        .filter(2 * (F.col("before") + F.col("sum")) - F.col("step") <= 2 * F.col("rest"))
        .groupBy(F.col("source").alias("end_of"))
        .agg(F.max("key").alias("end_key"))
    )
    of = F.col("of")
    bounds = (
        plan.join(last.drop("before"), of.eqNullSafe(F.col("last_of")), "left")
        .join(ends, of.eqNullSafe(F.col("end_of")), "left")
        .drop("last_of", "end_of")
    )
    return keep(bounds, "mix-bounds")


def shares_by_rank(weights: tuple[float, ...] = (1, 2, 3)) -> Column:
    """Weights given out to the sources in turn, by ``nth``."""
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    return F.element_at(cycle, ((F.col("nth") - 1) % len(weights) + 1).cast("int"))


def labelled_weight(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``weight``: 2 for documents labelled good, 0.5 for bad ones, else 1.

    The best label counts if there are several; a null id has none.
    """
    best = labels.groupBy(F.col("doc_id").alias("of")).agg(F.max("quality").alias("quality"))
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    return (
        docs.join(best, F.col("doc_id") == F.col("of"), "left")
        .withColumn("weight", weight)
        .drop("of", "quality")
    )
