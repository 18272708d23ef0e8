"""Shards along a Hilbert curve through several metadata columns.

Rows that lie close on the curve have similar values in every dimension, so a
shard, which is a run of the curve, covers a small box: its minima and maxima
let a reader skip it for filters on any of the dimensions.

The order is (curve index, a hash of the tie columns). Running sums over it
need no global sort in one task: rows are summed by cell of the grid and by
slices of the hash range, whose number follows the rows of the cell, so that a
cell with a third of all rows is many slices. Only rows of one slice meet in
one task.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .text import unit

#: Rows of a slice, the most that one task sorts together.
SLICE_ROWS = 20_000
#: Bytes of a text value that place it among the others, after the prefix that all share.
TEXT_BYTES = 6


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a point given by ``bits``-bit axes.

    Skilling's transform: undo the excess turns from the highest bit down,
    Gray-encode, interleave.
    """
    n = len(axes)
    point = F.array(*(a.cast("long") for a in axes))
    turns = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]

    def undo(x: Column, turn: Column) -> Column:
        low = turn["q"] - 1
        own = F.element_at(x, turn["i"] + 1)
        on = own.bitwiseAND(turn["q"]) != 0
        swap = x[0].bitwiseXOR(own).bitwiseAND(low)
        first = x[0].bitwiseXOR(F.when(on, low).otherwise(swap))
        return F.transform(
            x,
            lambda v, k: F.when(k == 0, first)
            .when(k == turn["i"], F.when(on, v).otherwise(v.bitwiseXOR(swap)))
            .otherwise(v),
        )

    if turns:
        program = F.array(
            *(
                F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i"))
                for q, i in turns
            )
        )
        point = F.aggregate(program, point, undo)

    def encode(x: Column) -> Column:
        gray = [x[0]]
        for i in range(1, n):
            gray.append(gray[-1].bitwiseXOR(x[i]))
        flip = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            set_ = gray[-1].bitwiseAND(F.lit(1 << b)) != 0
            flip = flip.bitwiseXOR(F.when(set_, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        index = F.lit(0).cast("long")
        for b in range(bits):
            for i in range(n):
                bit = F.shiftright(gray[i].bitwiseXOR(flip), b).bitwiseAND(F.lit(1).cast("long"))
                index = index + F.shiftleft(bit, b * n + n - 1 - i)
        return index

    return F.transform(F.array(point), encode)[0]


def _axis_numbers(df: DataFrame, dims: list[str]) -> list[Column]:
    """Each dimension as a number in the order of its values."""
    texts = [d for d in dims if isinstance(df.schema[d].dataType, T.StringType)]
    prefix = {}
    if texts:
        ends = df.agg(*(f(d).alias(f"{k}{i}") for i, d in enumerate(texts)
                        for k, f in (("a", F.min), ("b", F.max)))).first()
        for i, d in enumerate(texts):
            low, high = ends[f"a{i}"] or "", ends[f"b{i}"] or ""
            shared = os.path.commonprefix([low.encode(), high.encode()])
            prefix[d] = len(shared)

    def number(d: str) -> Column:
        kind = df.schema[d].dataType
        if d in prefix:
            part = F.substring(F.encode(F.col(d), "UTF-8"), prefix[d] + 1, TEXT_BYTES)
            return F.conv(F.rpad(F.hex(part), 2 * TEXT_BYTES, "0"), 16, 10).cast("double")
        if isinstance(kind, (T.DateType, T.TimestampNTZType)):
            return F.col(d).cast("timestamp").cast("double")
        return F.col(d).cast("double")

    return [number(d) for d in dims]


def grid(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """Each dimension as one of ``2**bits`` steps holding about equally many rows.

    Null and NaN take the lowest and the highest step. A value that fills
    several steps takes the lowest of them.
    """
    numbers = _axis_numbers(df, dims)
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = df.agg(
        *(F.percentile_approx(x, shares, 10_000).alias(f"c{i}") for i, x in enumerate(numbers))
    ).first()

    def step(i: int, x: Column) -> Column:
        total = F.lit(0)
        for cut in cuts[f"c{i}"] or []:
            total = total + F.when(x > F.lit(cut), 1).otherwise(0)
        return total

    return [step(i, x) for i, x in enumerate(numbers)]


def cut_shards(
    df: DataFrame,
    dims: list[str],
    size: Column,
    shards: int,
    ties: list[str],
    bits: int = 4,
) -> DataFrame:
    """All rows and columns of ``df`` plus ``placed``: (curve, shard, slot).

    Sizes of shards are equal but for one row at either end: a row goes to the
    shard in which the middle of its bytes falls. ``slot`` counts the rows of
    a shard from 0 along the curve.

    * Columns: every column of ``df`` is kept; only one named ``placed`` would
      be replaced.
    * Null size counts 0; if all sizes are 0, every row goes to shard 0.
    * Null dimensions lie at the low end of their axis.
    * Rows equal in all ``ties`` follow each other in no fixed order.
    * An empty table gives an empty table.

    The grid has ``2 ** (bits * len(dims))`` cells, 65,536 at most: a bound on
    what is broadcast.
    """
    if bits * len(dims) > 16:
        raise ValueError("the grid may have 65,536 cells at most")
    rows = df.select(
        F.struct(*(df[c] for c in df.columns if c != "placed")).alias("row"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.array(*grid(df, dims, bits)).alias("axes"),
        unit(*(F.col(c) for c in ties)).alias("at"),
    )
    # At most one row per cell of the grid: safe to broadcast and to scan in one task.
    cells = (
        rows.groupBy("axes")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
        .withColumn("curve", hilbert_index([F.col("axes")[i] for i in range(len(dims))], bits))
    )
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "axes",
        "curve",
        F.ceil(F.col("n") / SLICE_ROWS).alias("slices"),
        F.coalesce(F.sum("n").over(along), F.lit(0)).alias("cell_row"),
        F.coalesce(F.sum("bytes").over(along), F.lit(0)).alias("cell_byte"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    sliced = rows.join(F.broadcast(cells), "axes").withColumn(
        "slice", F.floor(F.col("at") * F.col("slices"))
    )
    before = Window.partitionBy("curve").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("curve", "slice")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("size").alias("bytes"),
            F.min("cell_row").alias("cell_row"),
            F.min("cell_byte").alias("cell_byte"),
        )
        .select(
            "curve",
            "slice",
            (F.col("cell_row") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("row0"),
            (F.col("cell_byte") + F.coalesce(F.sum("bytes").over(before), F.lit(0))).alias("byte0"),
        )
    )

    def numbered(what: list[str]) -> DataFrame:
        inside = Window.partitionBy("curve", "slice").orderBy("at", *(F.col("row")[c] for c in ties))
        upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        middle = 2 * (F.col("byte0") + F.col("seen")) - F.col("size")
        return (
            sliced.withColumn("nth", F.row_number().over(inside))
            .withColumn("seen", F.sum("size").over(upto))
            .join(offsets, ["curve", "slice"])
            .select(
                *what,
                "curve",
                (F.col("row0") + F.col("nth") - 1).alias("index"),
                F.least(
                    F.coalesce(
                        F.floor(middle * shards / F.nullif(2 * F.col("total"), F.lit(0))),
                        F.lit(0),
                    ),
                    F.lit(shards - 1),
                )
                .cast("int")
                .alias("shard"),
            )
        )

    starts = numbered([]).groupBy("shard").agg(F.min("index").alias("start"))  # a row per shard
    return (
        numbered(["row"])
        .join(F.broadcast(starts), "shard")
        .select(
            "row.*",
            F.struct("curve", "shard", (F.col("index") - F.col("start")).alias("slot")).alias(
                "placed"
            ),
        )
    )


def shard_documents(
    docs: DataFrame, shards: int = 40, dims: tuple[str, ...] = ("source", "lang", "n_chars")
) -> DataFrame:
    """Documents with ``placed``; a text weighs its UTF-8 bytes plus 16."""
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 16
    return cut_shards(docs, list(dims), size, shards, ties=["doc_id", "n_chars"])
