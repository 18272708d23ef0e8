"""Near copies by SimHash fingerprints, found through deletion-variant signatures.

Two fingerprints within two bits of each other, cut into only two halves of 32
bits, agree in one half but for one bit at most. Each half is therefore stored
as it is and once per bit with that bit as a wildcard; equality joins of these
variants find every pair, and the whole fingerprints are then compared. A pair
is met once: a wildcard variant only joins fingerprints with bit 0 to those
with bit 1, and the low half is left to pairs whose high halves differ more.

Equal fingerprints are one node, so exact copies make no pairs. A variant that
more than ``BUCKET`` fingerprints share makes no pairs either. Its members are
linked through the fingerprints around them: two fingerprints are within two
bits exactly if one of the 65 fingerprints within one bit of either is common
to both. Each member is tied to the smallest of those that share such a
neighbour with it, which is linear in the members and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .store import keep, small
from .text import whole

SHINGLE_WORDS = 3
SEED = 42
HALF = 32
#: Fingerprints in one variant up to which they are compared pair by pair.
BUCKET = 32
#: Shingles whose bits are counted at once, which bounds the memory for long texts.
BLOCK = 1 << 15


def fingerprint(text: str, size: int = SHINGLE_WORDS) -> int:
    """Majority of the bits of all shingles' hashes; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII only, as bytes
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    last = ends[min(size, len(words)) - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(last), BLOCK):
        part = last[at : at + BLOCK]
        hashes = np.fromiter(
            (digest(joined[s : e - 1], SEED) for s, e in zip(starts[at:], part)),
            dtype="<u8",
            count=len(part),
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(last), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def fingerprint_column(text: str = "text") -> Column:
    """Signed 64-bit fingerprint; a null text counts as an empty one."""
    return _fingerprints(whole(text))


def variants(nodes: DataFrame) -> DataFrame:
    """66 rows per fingerprint: (half, bit, rest, side, fp).

    ``bit`` is -1 for the half as it is, and ``side`` is 0; else ``rest`` is
    the half without that bit, and ``side`` is the bit.
    """
    halves = F.array(
        F.shiftrightunsigned("fp", HALF), F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))
    )
    split = nodes.select("fp", F.posexplode(halves).alias("half", "value"))
    each = split.select(
        "fp", "half", "value", F.explode(F.sequence(F.lit(-1), F.lit(HALF - 1))).alias("bit")
    )
    mask = F.expr("if(bit < 0, 0L, shiftleft(1L, bit))")
    return each.select(
        # Half, bit and rest in one number: 1 + 6 + 32 bits.
        (
            (F.col("half") * 64 + F.col("bit") + 1).cast("long") * F.lit(1 << HALF)
            + F.col("value").bitwiseAND(F.bitwise_not(mask))
        ).alias("variant"),
        (F.col("value").bitwiseAND(mask) != 0).alias("side"),
        "fp",
    )


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints within two bits of each other.

    ``nodes``: distinct fingerprints in column fp.
    """
    index = variants(nodes)
    exact = (F.shiftright("variant", HALF) % 64) == 0
    ones = F.sum(F.col("side").cast("int"))
    all_ = F.count(F.lit(1))
    shared = keep(
        index.groupBy("variant")
        .agg(all_.alias("n"), ones.alias("ones"))
        .filter((F.col("n") > 1) & (exact | ((F.col("ones") > 0) & (F.col("ones") < F.col("n")))))
        .select("variant", (F.col("n") > BUCKET).alias("hot")),
        "shared-variants",
    )
    members = keep(index.join(small(shared, 1_000_000), "variant"), "members")
    few = members.filter("not hot").drop("hot")
    left = few.select("variant", F.col("side").alias("sa"), F.col("fp").alias("a"))
    right = few.select("variant", F.col("side").alias("sb"), F.col("fp").alias("b"))
    low = F.shiftright("variant", HALF) >= 64
    apart = F.col("a").bitwiseXOR(F.col("b"))
    pairs = left.join(right, "variant").filter(
        (
            (exact & (F.col("a") < F.col("b")))
            | (~exact & ~F.col("sa") & F.col("sb"))
        )
        & (F.bit_count(apart) <= 2)
        & (~low | (F.bit_count(F.shiftrightunsigned(apart, HALF)) > 1))
    )
    hot = members.filter("hot").select("fp").distinct()
    around = keep(
        hot.select(
            "fp",
            F.explode(
                F.concat(
                    F.array("fp"),
                    F.transform(
                        F.sequence(F.lit(0), F.lit(63)),
                        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
                    ),
                )
            ).alias("near"),
        ),
        "around",
    )
    least = keep(
        around.groupBy("near")
        .agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n"),
        "around-least",
    )
    stars = around.join(least, "near").filter("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.select("a", "b").union(stars)


def _groups(marked: DataFrame) -> DataFrame:
    """(fp, id, root) per fingerprint: its smallest id and its component's smallest fingerprint."""
    nodes = keep(marked.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    groups = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    # Fingerprints without a link are their own component.
    rooted = nodes.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return keep(rooted, "rooted")


def _marked(docs: DataFrame, columns: list[str], text: str, id_: str) -> DataFrame:
    rows = docs.select(
        F.struct(*(docs[c] for c in columns)).alias("row"),
        F.col(id_).alias("id"),
        fingerprint_column(text).alias("fp"),
    )
    return keep(rows, "fingerprints")


def near_copies(
    docs: DataFrame, text: str = "text", id_: str = "doc_id", columns: list[str] | None = None
) -> DataFrame:
    """All rows of ``docs`` plus ``near``: (fingerprint, component).

    ``component`` is the smallest id among the rows reachable over
    fingerprints that differ in two bits or fewer; null if none has an id.

    * Columns: those named (all by default) but one called ``near``.
    * Null, empty and blank texts have fingerprint 0 and are linked like any other.
    * Fewer words than a shingle: the words are one shingle.
    * Repeated rows share fingerprint and component.
    * An empty table gives an empty table.
    """
    marked = _marked(docs, [c for c in columns or docs.columns if c != "near"], text, id_)
    rooted = _groups(marked)
    firsts = rooted.groupBy("root").agg(F.min("id").alias("component"))
    table = keep(rooted.join(firsts, "root").select("fp", "component"), "components")
    return marked.join(table, "fp").select(
        "row.*", F.struct(F.col("fp").alias("fingerprint"), "component").alias("near")
    )


def one_of_each(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row per component of ``near_copies``, with the columns of ``docs``.

    The row with the smallest id stays; rows without an id only where their
    component has no other. Of several rows with that id and fingerprint, as
    with repeated rows, one with the smallest text stays.
    """
    marked = _marked(docs, docs.columns, text, id_)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("first")
    firsts = _groups(marked).groupBy("root").agg(first)

    def key(id_column: Column) -> Column:
        return F.coalesce(id_column.cast("string"), F.lit(""))

    winners = keep(
        firsts.select(F.col("first.fp").alias("fp"), key(F.col("first.id")).alias("key")), "winners"
    )
    # An id and a fingerprint are few rows even where copies are many.
    return (
        marked.withColumn("key", key(F.col("id")))
        .join(winners, ["fp", "key"], "left_semi")
        .groupBy("fp", "key")
        .agg(F.min_by("row", whole(F.col("row")[text])).alias("row"))
        .select("row.*")
    )
