"""Approximate nearest neighbours: NN-descent, then greedy search in its graph.

A graph of ``LIST`` neighbours per vector starts from random blocks. In each
round every vector's neighbours, and those that have it as a neighbour, are
joined with their codes and introduced to each other: neighbours of neighbours
that are nearer than what a list holds replace its last entries. Only pairs
with a new link are looked at, and rounds end when few lists change.

A query starts at its own vector and at the best for it of the ``HEADS`` longest
vectors, and follows the graph: the lists of the best ones found and not yet
opened are scored against it, until a round changes none of its ``k`` best. What
is found is scored once more, in double precision on the original vectors.

The graph is one of directions: it ranks by -|a - b|^2 / 2 of unit vectors, which
keeps small differences of near copies, so its links lead everywhere whatever
the lengths. The largest inner products belong to long vectors, so the search
ranks by the inner product itself and sets out from the longest, too. Codes hold
the direction in single precision and the length in double; both rankings are
computed in double precision. Vectors with exactly one direction are alike to
the graph, so of a group of more than ``LIST`` of them the longest are sure to be
met only among the heads.

Links to a vector beyond the nearest ``BACK`` are not followed back, as usual
in NN-descent: it is approximate, and recall is measured. Equal vectors are one
vector of the graph, however many rows share it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import keep, small

LIST = 64
BACK = 64
#: Vectors of a random block at the start, and how many such blocks each is in.
BLOCK = 512
BLOCKINGS = 3
#: Nearest others that a vector takes from a block.
FROM_BLOCK = 24
#: Candidates a vector takes from one introduction.
TAKE = 8
ROUNDS = 8
#: A round that changes a smaller share of all links is the last one.
SETTLED = 0.1
#: Vectors a search opens per round, and rounds after which it may end.
OPEN = 24
AT_LEAST = 2
#: Longest vectors that all queries are scored against at the start.
HEADS = 2048
#: Queries, and heads, that are scored against each other at once.
ASKED = 256
#: Scored candidates a task gathers before it drops all but the best of a vector.
GATHER = 500_000
#: Blocks or neighbourhoods handed to a task at once, some 40 KB each at 64 components.
HANDED = 200


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``HANDED`` rows in the jobs run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(HANDED))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Codes:
    """A binary column of codes: the direction in single precision, then the length in double."""

    def __init__(self, column: pa.Array) -> None:
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
        flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)
        self.rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)

    def directions(self, part: slice) -> np.ndarray:
        rows = self.rows[part]
        if not rows.size:
            return np.empty((len(rows), 0))
        return np.ascontiguousarray(rows[:, :-8]).view(np.float32).astype(np.float64)

    def lengths(self, part: slice) -> np.ndarray:
        return np.ascontiguousarray(self.rows[part][:, -8:]).view(np.float64)[:, 0]


def encode(x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Codes of vectors, and their lengths. The largest component goes out first, as squares may overflow."""
    largest = np.abs(x).max(axis=1, keepdims=True)
    unit = x / largest
    short = np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    with np.errstate(over="ignore"):
        length = np.minimum(largest * short, np.finfo(np.float64).max)
    flat = (unit / short).astype(np.float32)
    return [a.tobytes() + b.tobytes() for a, b in zip(flat, length)], length[:, 0]


def _nearness(codes: np.ndarray) -> np.ndarray:
    """-|a - b|^2 / 2 of all pairs."""
    product = codes @ codes.T
    half = np.diagonal(product) / 2
    return product - half[:, None] - half[None, :]


def _best(node: np.ndarray, other: np.ndarray, score: np.ndarray, most: int) -> tuple:
    """Of scored pairs, once each, the best ``most`` of a node."""
    order = np.lexsort((other, -score, node))
    node, other, score = node[order], other[order], score[order]
    again = np.zeros(len(node), bool)
    again[1:] = (node[1:] == node[:-1]) & (other[1:] == other[:-1])
    node, other, score = node[~again], other[~again], score[~again]
    first = np.searchsorted(node, node)
    near = np.arange(len(node)) - first < most
    return node[near], other[near], score[near]


def _pairs(node: np.ndarray, other: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"node": pa.array(node), "other": pa.array(other), "score": pa.array(score.astype(np.float64))}
    )


PAIR = "node long, other long, score double"


def _gathered(parts: Iterator[tuple], most: int) -> Iterator[pa.RecordBatch]:
    """Scored pairs, with no more than the best of each node per GATHER of them."""
    held: list[tuple] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= GATHER:
            yield _pairs(*_best(*map(np.concatenate, zip(*held)), most))
            held, size = [], 0
    if held:
        yield _pairs(*_best(*map(np.concatenate, zip(*held)), most))


def _members(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Of rows with a list of structs, each list's flat fields, directions and lengths."""
    lists = batch.column("members")
    bounds = lists.offsets.to_numpy()
    flat = lists.flatten()
    base = bounds[0]
    fields = {f.name: flat.field(f.name) for f in flat.type}
    codes = Codes(fields.pop("code"))
    plain = {k: v.to_numpy(zero_copy_only=False) for k, v in fields.items()}
    for i in range(batch.num_rows):
        part = slice(bounds[i] - base, bounds[i + 1] - base)
        yield i, {k: v[part] for k, v in plain.items()}, codes.directions(part), codes.lengths(part)


def _block_lists(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The ``most`` nearest others of each vector inside its block."""

    def parts() -> Iterator[tuple]:
        for batch in batches:
            for _, m, codes, _ in _members(batch):
                yield from _nearest(_nearness(codes), m["node"], None, most)

    yield from _gathered(parts(), LIST)


def _nearest(score: np.ndarray, node: np.ndarray, floor: np.ndarray | None, most: int) -> Iterator[tuple]:
    n = len(node)
    if n < 2:
        return
    np.fill_diagonal(score, -np.inf)
    if floor is not None:
        score[score <= floor[:, None]] = -np.inf
    most = min(most, n - 1)
    best = np.argpartition(-score, most - 1, axis=1)[:, :most]
    value = np.take_along_axis(score, best, 1)
    row, column = np.nonzero(value > -np.inf)
    yield node[row], node[best[row, column]], value[row, column]


def _introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a neighbourhood that would enter each other's lists, over a new link."""

    def parts() -> Iterator[tuple]:
        for batch in batches:
            for _, m, codes, _ in _members(batch):
                new = m["new"].astype(bool)
                if not new.any():
                    continue
                score = _nearness(codes)
                score[~(new[:, None] | new[None, :])] = -np.inf
                yield from _nearest(score, m["node"], m["floor"], TAKE)

    yield from _gathered(parts(), LIST)


def _top(pairs: DataFrame, most: int, by: str = "node") -> DataFrame:
    """The ``most`` nearest of each node; Spark keeps that many per task before it shuffles."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "other")
    return pairs.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).drop("nth")


def neighbour_graph(codes: DataFrame) -> DataFrame:
    """(node, other, score): nearest others of each node of ``codes`` (node, code).

    A kept table. Fewer others than ``LIST`` are all listed; a table of one
    vector gives no rows.
    """
    n = codes.count()
    blocks = max(1, -(-n // BLOCK))
    dealt = codes.select(
        "node",
        "code",
        F.explode(
            F.array(
                *(F.struct(F.lit(k).alias("k"), F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(blocks)).alias("b"))
                  for k in range(BLOCKINGS if blocks > 1 else 1))
            )
        ).alias("of"),
    )
    start = dealt.groupBy("of").agg(F.collect_list(F.struct("node", "code")).alias("members"))
    most = FROM_BLOCK if blocks > 1 else LIST
    first = start.select("members").mapInArrow(partial(_block_lists, most=most), PAIR)
    spark = codes.sparkSession
    with _small_batches(spark):
        graph = keep(_top(first.groupBy("node", "other").agg(F.max("score").alias("score")), LIST).withColumn("new", F.lit(True)), "graph")
    for _ in range(ROUNDS if blocks > 1 else 0):
        with _small_batches(spark):
            graph = keep(_descend(graph, codes), "graph")
        changed = graph.filter("new").count()
        if changed <= SETTLED * n * LIST:
            break
    return graph


def _around(graph: DataFrame) -> DataFrame:
    """(hub, node, new): each hub's neighbours, and the nearest of those that list it."""
    back = _top(
        graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "score", "new"), BACK
    )
    both = graph.select(F.col("node").alias("hub"), F.col("other").alias("node"), "new").union(
        back.select(F.col("node").alias("hub"), F.col("other").alias("node"), "new")
    )
    return both.groupBy("hub", "node").agg(F.max("new").alias("new"))


def _descend(graph: DataFrame, codes: DataFrame) -> DataFrame:
    floor = graph.groupBy("node").agg(
        F.when(F.count(F.lit(1)) >= LIST, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor")
    )
    known = codes.join(floor, "node")
    hoods = (
        _around(graph)
        .join(known, "node")
        .groupBy("hub")
        .agg(F.collect_list(F.struct("node", "new", "floor", "code")).alias("members"))
        .select("members")
    )
    met = hoods.mapInArrow(_introduce, PAIR).withColumn("old", F.lit(0))
    all_ = met.union(graph.select("node", "other", "score", F.lit(1).alias("old")))
    once = all_.groupBy("node", "other").agg(F.max("score").alias("score"), F.max("old").alias("old"))
    return _top(once, LIST).select("node", "other", "score", (F.col("old") == 0).alias("new"))


def _open_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of the vectors around an opened one against the queries that opened it."""

    def parts() -> Iterator[tuple]:
        for batch in batches:
            queries = batch.column("queries")
            bounds = queries.offsets.to_numpy()
            flat = queries.flatten()
            ids = flat.field("query").to_numpy(zero_copy_only=False)
            asked = Codes(flat.field("asked"))
            for i, m, codes, lengths in _members(batch):
                part = slice(bounds[i] - bounds[0], bounds[i + 1] - bounds[0])
                score = (asked.directions(part) @ codes.T) * lengths
                n, k = score.shape
                yield np.repeat(ids[part], k), np.tile(m["node"], n), score.ravel()

    yield from _gathered(parts(), LIST)


def heads(packed: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(node, other, score): of the ``HEADS`` longest vectors of ``packed``, the best for each query.

    Queries are dealt into blocks of about ``ASKED``, and the heads, of fixed
    number, into parts of as many; each block meets each part once.
    """
    parts = HEADS // ASKED
    longest = packed.select("node", "length").orderBy(F.col("length").desc(), "node").limit(HEADS)
    members = (
        packed.join(keep(longest.select("node"), "heads"), "node", "left_semi")
        .groupBy(F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part"))
        .agg(F.collect_list(F.struct("node", "code")).alias("members"))
    )
    blocks = max(1, -(-queries.count() // ASKED))
    asking = (
        queries.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"))
        .agg(F.collect_list(F.struct("query", "asked")).alias("queries"))
        .select("queries", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("part"))
    )
    met = asking.join(members, "part").select("queries", "members").mapInArrow(_open_lists, PAIR)
    with _small_batches(packed.sparkSession):
        return keep(_top(met, most), "starts")


def search(
    graph: DataFrame, codes: DataFrame, queries: DataFrame, starts: DataFrame, most: int, k: int
) -> DataFrame:
    """(node, other, score) with node the query: the best ``most`` met by greedy search.

    ``queries``: (query, asked), ``asked`` a code. ``starts``: (node, other, score),
    vectors with which the search of query ``node`` sets out. A query ends when a
    round brings nothing new into its ``k`` best.
    """
    # Without codes, which would be on disk once per neighbourhood.
    around = keep(_around(graph).select("hub", "node"), "neighbourhoods")
    found = starts.select(
        "node", "other", "score", F.lit(False).alias("opened"), F.lit(True).alias("goes_on")
    )
    for turn in count(1):
        order = Window.partitionBy("node").orderBy("opened", F.col("score").desc(), "other")
        marked = keep(
            found.withColumn("nth", F.row_number().over(order))
            .withColumn("now", F.col("goes_on") & ~F.col("opened") & (F.col("nth") <= OPEN))
            .drop("nth", "goes_on"),
            "opening",
        )
        now = marked.filter("now").select("node", F.col("other").alias("hub"))
        asked_of = keep(now.groupBy("hub").count(), "opened")
        if asked_of.isEmpty():
            break
        # A vector that many queries open is opened in parts of about ``ASKED`` of them.
        hot = asked_of.filter(F.col("count") > ASKED).select(
            "hub", F.ceil(F.col("count") / ASKED).alias("parts")
        )
        opening = (
            now.join(small(keep(hot, "hot")), "hub", "left")
            .join(queries, F.col("node") == F.col("query"))
            .groupBy("hub", F.pmod(F.xxhash64("query"), F.coalesce("parts", F.lit(1))).alias("part"))
            .agg(F.collect_list(F.struct("query", "asked")).alias("queries"))
        )
        hoods = (
            around.join(asked_of, "hub", "left_semi")
            .join(codes, "node")
            .groupBy("hub")
            .agg(F.collect_list(F.struct("node", "code")).alias("members"))
        )
        met = (
            opening.join(hoods, "hub")
            .select("queries", "members")
            .mapInArrow(_open_lists, PAIR)
            .withColumn("opened", F.lit(False))
            .withColumn("old", F.lit(False))
        )
        old = marked.select(
            "node", "other", "score", (F.col("opened") | F.col("now")).alias("opened"), F.lit(True).alias("old")
        )
        once = (
            old.union(met)
            .groupBy("node", "other")
            .agg(F.min("score").alias("score"), F.max("opened").alias("opened"), F.max("old").alias("old"))
        )
        best = Window.partitionBy("node").orderBy(F.col("score").desc(), "other")
        new = ~F.col("old") & (F.col("nth") <= k)
        with _small_batches(codes.sparkSession):
            found = keep(
                once.withColumn("nth", F.row_number().over(best))
                .filter(F.col("nth") <= most)
                .withColumn("goes_on", F.lit(turn < AT_LEAST) | F.max(new).over(Window.partitionBy("node")))
                .drop("nth", "old"),
                "search",
            )
    return found.select("node", "other", "score")


def _plain(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = _plain(vector)
    return F.coalesce(
        (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False)
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
        codes, lengths = encode(flat.reshape(n, -1))
        yield pa.RecordBatch.from_pydict(
            {"node": batch.column("node"), "code": pa.array(codes, pa.binary()), "length": pa.array(lengths)}
        )


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, id_: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query row among all others.

    Nearness is the inner product in double precision; ties go to the smaller
    id. A query is no candidate of its own, but rows with an equal vector are.

    * Null ids, and vectors that are null, empty, zero, or hold null, NaN or
      infinity take no part; nor do vectors of another than the commonest
      length (the smaller of two equally common ones).
    * Of rows repeating an id the smallest vector counts.
    * Fewer candidates than ``k``: all of them. No query, or an empty table: no rows.
    """
    rows = (
        vectors.filter(usable(F.col(vector)) & F.col(id_).isNotNull())
        .select(F.col(id_).alias("id"), is_query.alias("asks"), _plain(F.col(vector)).alias("vector"))
        .groupBy("id")
        .agg(F.min(F.struct("vector", "asks")).alias("r"))
        .select("id", "r.*", F.size("r.vector").alias("size"))
    )
    rows = keep(rows, "vectors")
    sizes = rows.groupBy("size").count().orderBy(F.col("count").desc(), "size").limit(1)
    rows = rows.join(F.broadcast(sizes.select("size")), "size", "left_semi")  # one row
    # Equal vectors are one node, named by its smallest id. Their k + 1 smallest ids
    # are all that a list of k can need of them.
    nodes = keep(rows.groupBy("vector").agg(F.min("id").alias("node")), "nodes")
    if nodes.isEmpty():
        return rows.select(
            F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")
        )
    packed = keep(
        nodes.select("node", "vector").mapInArrow(_pack, "node long, code binary, length double"), "codes"
    )
    codes = packed.select("node", "code")
    of = keep(
        rows.join(nodes.select("vector", "node"), "vector").select("id", "asks", "node"), "row-nodes"
    )
    asking = of.filter("asks").select("node").distinct()
    queries = keep(
        packed.join(asking, "node", "left_semi").select(F.col("node").alias("query"), F.col("code").alias("asked")),
        "queries",
    )
    graph = neighbour_graph(codes)
    # A query's own vector is in the graph: its search sets out there, too.
    own = asking.select("node", F.col("node").alias("other"))
    starts = heads(packed, queries, LIST).filter("node <> other").union(
        own.withColumn("score", F.lit(float("inf")))
    )
    found = search(graph, codes, queries, starts, LIST, k)
    # It is a candidate too where other rows share it.
    found = found.select("node", "other").union(own).distinct()
    small_ids = Window.partitionBy("node").orderBy("id")
    members = keep(
        of.withColumn("nth", F.row_number().over(small_ids)).filter(F.col("nth") <= k + 1).select("node", "id"),
        "members",
    )
    exact = F.aggregate(
        F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )
    scored = (
        found.join(nodes.select("node", F.col("vector").alias("a")), "node")
        .join(nodes.select(F.col("node").alias("other"), F.col("vector").alias("b")), "other")
        .select("node", "other", exact.alias("score"))
    )
    # Of equal vectors the k + 1 smallest ids, and of all these the best for each asking vector.
    spread = keep(
        scored.join(members.withColumnRenamed("node", "other").withColumnRenamed("id", "vec_id"), "other"),
        "scored",
    )
    best = Window.partitionBy("node").orderBy(F.col("score").desc(), "vec_id")
    lists = spread.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1).drop("nth")
    per_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        of.filter("asks")
        .select(F.col("id").alias("query_id"), "node")
        .join(keep(lists.select("node", "vec_id", "score"), "lists"), "node")
        .filter("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(per_query))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
