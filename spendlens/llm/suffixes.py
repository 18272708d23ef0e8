"""Removal of repeated passages of 100 bytes or more, by suffix sorting.

A byte goes if a 100-byte string over it also starts earlier, in a smaller
document or earlier in the same one. Suffixes are sorted by the difference-cover
algorithm: triples at two of three positions are sorted and named, the names
are ranked by recursion, the remaining suffixes are merged in, and
neighbours in the order are compared over 100 bytes.

Sorting every suffix of a corpus would move it many times over, so the sort is
cut into independent ones first, without loss:

1. Each 100-byte string has an anchor, the 32 bytes in it with the smallest hash.
   Equal strings have equal anchors at the same place. The strings of one anchor
   are neighbours and make up its context, of 168 bytes at most.
2. Anchors are shuffled by hash. Of equal contexts all but the first are repeats
   as a whole; contexts whose anchor is nowhere else are none. What is left,
   mostly the ends of copied passages, is sorted.
3. Contexts are dealt out by anchor and sorted in blocks that fit a task. Strings
   of an anchor with more contexts than a block are grouped by Spark instead.

Equal contexts are told by 128 bits of hash. Everything shuffled has a fixed
small size, apart from texts, which are shuffled once to cut contexts out and
once to cut repeats out, and only if they have any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import keep, small

LENGTH = 100
ANCHOR = 32
REACH = LENGTH - ANCHOR
#: Bytes that every string has on one side of its anchor at least.
HALF = REACH // 2
#: Bytes sorted together; symbols and ranks of a block fit 21 bits.
BLOCK = 1_500_000
#: Anchors that a task gathers before it drops repeats among them.
GATHER = 1_000_000
#: Texts up to which the list of those that matter is broadcast (16 bytes each).
LISTED = 1_000_000

C1, C2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
SYMBOL = np.uint64(21)


# -- the difference-cover sort ------------------------------------------------


def rank_suffixes(symbols: np.ndarray, need: int) -> np.ndarray:
    """Numbers that order suffixes by their first ``need`` symbols at least.

    Suffixes that agree in them have neighbouring numbers, in any order.
    Symbols are from 0 to fewer than 2**21 - 1, and so is the length.
    """
    n = len(symbols)
    names = np.unique(symbols, return_inverse=True)[1].astype(np.uint64)
    if need <= 1 or n < 3:
        return names
    text = np.concatenate([names + np.uint64(1), np.zeros(3, np.uint64)])
    rest, first, second = (np.arange(k, n, 3) for k in (0, 1, 2))

    def triple(at: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (text[at] << SYMBOL | text[at + 1]) << SYMBOL | last[at + 2]

    # Sort and name the triples at the sampled positions.
    keys, named = np.unique(
        np.concatenate([triple(first, text), triple(second, text)]), return_inverse=True
    )
    if need > 3 and len(keys) < len(named):
        # Recurse on the names; 0 ends the first run.
        joined = np.concatenate([named[: len(first)] + 1, [0], named[len(first) :] + 1])
        ranks = rank_suffixes(joined, -(-need // 3))
        named = np.delete(ranks, len(first))
    rank = np.zeros(n + 3, np.uint64)
    rank[first] = named[: len(first)] + 1
    rank[second] = named[len(first) :] + 1
    # Merge the remaining suffixes: one symbol, or two, and the rank behind them.
    single = lambda at: text[at] << SYMBOL | rank[at + 1]
    rest_one, rest_two = single(rest), triple(rest, rank)
    first_one, second_two = single(first), triple(second, rank)
    sampled = np.sort(np.concatenate([rank[first], rank[second]]))
    below = lambda sorted_, x: np.searchsorted(np.sort(sorted_), x)
    order = np.empty(n, np.int64)
    order[rest] = below(rest_one, rest_one) + below(first_one, rest_one) + below(second_two, rest_two)
    order[first] = np.searchsorted(sampled, rank[first]) + below(rest_one, first_one)
    order[second] = np.searchsorted(sampled, rank[second]) + below(rest_two, second_two)
    return order


def repeats(text: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Of the positions ``valid``, those whose string also starts at a smaller one of them.

    ``text`` holds bytes raised by one, and 0 between contexts; no string at a
    valid position reaches such an end.
    """
    order = valid[np.argsort(rank_suffixes(text, LENGTH)[valid], kind="stable")]
    plain = (text - 1).astype(np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(plain, 8)
    words = np.ascontiguousarray(eight).view(np.uint64).ravel()
    same = np.ones(max(len(order) - 1, 0), bool)
    for at in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        same &= words[order[1:] + at] == words[order[:-1] + at]
    group = np.concatenate([[0], np.cumsum(~same)])
    least = np.full(group[-1] + 1, len(text))
    np.minimum.at(least, group, order)
    return order[order > least[group]]


# -- anchors ------------------------------------------------------------------


def _double(h: np.ndarray, span: int) -> np.ndarray:
    """Hashes of twice the length, from those of ``span`` bytes."""
    a = h[:-span] * C1
    a ^= a >> np.uint64(29)
    a += h[span:]
    a *= C2
    a ^= a >> np.uint64(32)
    return a


def _mix(parts: list[np.ndarray]) -> np.ndarray:
    c = np.full(len(parts[0]), C2)
    for p in parts:
        c = (c ^ p) * C1
        c ^= c >> np.uint64(29)
    return c


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 32 and of 64 bytes from each position."""
    h = (data.astype(np.uint64) + np.uint64(1)) * C1
    h ^= h >> np.uint64(31)
    found = {}
    span = 1
    while span < 64:
        h = _double(h, span)
        span *= 2
        found[span] = h
    return found[ANCHOR], found[64]


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first string, last string, anchor) of a text of 100 bytes or more."""
    short, long = _hashes(data)
    # The position in the low half settles ties from the left, and is read back.
    least = short & np.uint64(0xFFFFFFFF00000000) | np.arange(len(short), dtype=np.uint64)
    width, span = REACH + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = len(short) - width + 1
    least = np.minimum(least[:n], least[width - span : width - span + n])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(at))
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [n - 1]])
    far = last - first + LENGTH - 64
    context = _mix([long[first], long[first + far // 2], long[first + far], far.astype(np.uint64)])
    return short[at[first]].view(np.int64), context.view(np.int64), first, last, at[first]


FIELDS = ["anchor", "context", "doc", "tie", "first", "last", "at"]
KINDS = "anchor long, context long, doc long, tie long, first int, last int, at int"


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}


def _as_batch(columns: dict[str, np.ndarray], kinds: dict[str, type]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(columns[k].astype(t)) for k, t in kinds.items()})


def _flags(rows: dict[str, np.ndarray], before: dict | None) -> tuple[np.ndarray, ...]:
    """Of sorted rows: new anchor, new context, and no second copy of the same place."""

    def changed(name: str) -> np.ndarray:
        x = rows[name]
        start = x[:1] != before[name] if before else np.array([True])
        return np.concatenate([start, x[1:] != x[:-1]])

    anchor = changed("anchor")
    context = anchor | changed("context")
    place = context | changed("doc") | changed("tie") | changed("first")
    return anchor, context, place


TYPES = dict.fromkeys(FIELDS[:4], np.int64) | dict.fromkeys(FIELDS[4:], np.int32)


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of KINDS and ``repeat``: a context that this task has met in an earlier place."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        rows = dict(zip(FIELDS, map(np.concatenate, zip(*held))))
        order = np.lexsort([rows[c] for c in ("first", "tie", "doc", "context", "anchor")])
        rows = {k: v[order] for k, v in rows.items()}
        _, new, place = _flags(rows, None)
        rows["repeat"] = ~new
        rows = {k: v[place] for k, v in rows.items()}
        return _as_batch(rows, TYPES | {"repeat": bool})

    for batch in batches:
        docs, ties, bodies = (batch.column(c) for c in ("doc", "tie", "body"))
        for doc, tie, body in zip(docs.to_pylist(), ties.to_pylist(), bodies):
            data = np.frombuffer(body.as_buffer(), np.uint8)
            a, c, first, last, at = anchors(data)
            n = len(a)
            held.append((a, c, np.full(n, doc), np.full(n, tie), first, last, at))
            size += n
            if size >= GATHER:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, context and place: repeats, and contexts left to compare.

    A row per repeated context, and per first place of a context whose anchor
    has more than one. The first context of an anchor waits for a second.
    """
    before: dict | None = None
    waiting: dict | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _columns(batch)
        anchor, context, place = _flags(rows, before)
        held, waiting_is_open = waiting, False
        if waiting is not None:
            own = np.flatnonzero(anchor)
            upto = own[0] if len(own) else len(anchor)
            waiting_is_open = bool(context[:upto].any())
            if waiting_is_open or len(own):
                waiting = None
        group = np.cumsum(anchor)
        contexts = np.bincount(group, context, minlength=group[-1] + 1)
        # Group 0 goes on from the batch before, where its first context was met.
        many = contexts > 1
        many[0] = True
        open_ = context & many[group]
        repeat = place & ~context
        out = {k: v[open_ | repeat] for k, v in rows.items()} | {"open": open_[open_ | repeat]}
        if waiting_is_open:
            out = {
                k: np.concatenate([[held[k] if k != "open" else True], v]) for k, v in out.items()
            }
        # The last anchor may have had only one context so far.
        if anchor.any() and contexts[group[-1]] == 1:
            i = np.flatnonzero(anchor)[-1]
            waiting = {k: v[i] for k, v in rows.items()}
        before = {k: v[-1] for k, v in rows.items()}
        if len(out["doc"]):
            yield _as_batch(out, TYPES | {"open": bool})


# -- contexts -----------------------------------------------------------------


def _worth_sorting(anchor: np.ndarray, at: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Contexts that agree with another of their anchor over 34 bytes on its left or right.

    Any string reaches that far on one side. Equal hashes only keep more.
    """
    size = np.array([len(t) for t in texts])
    start = size.cumsum() - size
    data = np.frombuffer(b"".join(texts) + bytes(LENGTH), np.uint8)
    weight = _mix([np.arange(HALF, dtype=np.uint64) + np.uint64(7)])
    useful = np.zeros(len(texts), bool)
    for side, begin, has in (
        (1, start + at - HALF, at >= HALF),
        (2, start + at + ANCHOR, size - at - ANCHOR >= HALF),
    ):
        rows = np.flatnonzero(has)
        part = data[begin[rows, None] + np.arange(HALF)].astype(np.uint64)
        key = _mix([(part * weight).sum(axis=1, dtype=np.uint64), anchor[rows].view(np.uint64)])
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        useful[rows] |= count[inverse] > 1
    return useful


def _compare(held: list[tuple]) -> pa.RecordBatch | None:
    """Strings of a block of contexts that start in an earlier one."""
    anchor, doc, tie, first, at = (np.array(c, np.int64) for c in zip(*(h[:5] for h in held)))
    texts = [h[5] for h in held]
    chosen = np.flatnonzero(_worth_sorting(anchor, at - first, texts))
    if len(chosen) < 2:
        return None
    # Places in order, so that a smaller position in the block is an earlier one.
    chosen = chosen[np.lexsort([first[chosen], tie[chosen], doc[chosen]])]
    size = np.array([len(texts[i]) for i in chosen])
    text = np.zeros((size + 1).sum() + LENGTH, np.int64)
    start = np.concatenate([[0], (size + 1).cumsum()[:-1]])
    valid = []
    for b, i in zip(start, chosen):
        text[b : b + len(texts[i])] = np.frombuffer(texts[i], np.uint8)
        text[b : b + len(texts[i])] += 1
        valid.append(np.arange(b, b + len(texts[i]) - LENGTH + 1))
    found = repeats(text, np.concatenate(valid))
    if not len(found):
        return None
    of = np.searchsorted(start, found, side="right") - 1
    row = chosen[of]
    where = first[row] + found - start[of]
    return _as_batch(
        {"doc": doc[row], "tie": tie[row], "first": where, "last": where},
        {"doc": np.int64, "tie": np.int64, "first": np.int32, "last": np.int32},
    )


def _sort_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated strings of contexts, which come ordered by anchor."""
    held: list[tuple] = []
    size, whole = 0, 0  # bytes held, and contexts of anchors that are complete
    for batch in batches:
        names = ("anchor", "doc", "tie", "first", "at", "bytes")
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if held and held[-1][0] != row[0]:
                whole = len(held)
            if size + len(row[5]) > BLOCK and whole:
                if (found := _compare(held[:whole])) is not None:
                    yield found
                held, whole = held[whole:], 0
                size = sum(len(h[5]) for h in held)
            held.append(row)
            size += len(row[5])
    if held and (found := _compare(held)) is not None:
        yield found


def _all_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes and places of all strings of contexts."""
    for batch in batches:
        for doc, tie, first, body in zip(
            *(batch.column(c).to_pylist() for c in ("doc", "tie", "first", "bytes"))
        ):
            _, long = _hashes(np.frombuffer(body, np.uint8))
            n = len(body) - LENGTH + 1
            yield pa.RecordBatch.from_pydict(
                {
                    "h": pa.array(long[:n].view(np.int64)),
                    "g": pa.array(long[LENGTH - 64 :][:n].view(np.int64)),
                    "doc": pa.array(np.full(n, doc)),
                    "tie": pa.array(np.full(n, tie)),
                    "first": pa.array((first + np.arange(n)).astype(np.int32)),
                }
            )


# -- the whole ----------------------------------------------------------------

PLACE = "doc long, tie long, first int, last int"


def repeated_strings(texts: DataFrame) -> DataFrame:
    """(doc, tie, first, last): strings that start earlier start from first to last.

    ``texts``: (doc, tie, body); places are ordered by doc, tie and position.
    Rows equal in doc and tie are one text.
    """
    texts = texts.filter(F.octet_length("body") >= LENGTH)
    found = keep(texts.mapInArrow(_find_anchors, f"{KINDS}, repeat boolean"), "anchors")
    by_place = ["anchor", "context", "doc", "tie", "first"]
    sorted_out = keep(
        found.filter("not repeat")
        .select(*FIELDS)
        .repartition("anchor")
        .sortWithinPartitions(*by_place)
        .mapInArrow(_sort_out, f"{KINDS}, open boolean"),
        "contexts",
    )
    open_ = sorted_out.filter("open")
    crowded = keep(
        open_.groupBy("anchor")
        .agg(F.sum(F.col("last") - F.col("first") + LENGTH).alias("bytes"))
        .filter(F.col("bytes") > BLOCK)
        .select("anchor", F.lit(True).alias("crowded")),
        "crowded-anchors",
    )
    wanted = keep(
        open_.groupBy("doc", "tie").agg(
            F.collect_list(F.struct("anchor", "first", "last", "at")).alias("own")
        ),
        "open-texts",
    )
    listed = small(wanted.select("doc", "tie"), LISTED)
    cut = F.transform(
        "own",
        lambda c: F.struct(
            c["anchor"].alias("anchor"),
            c["first"].alias("first"),
            c["at"].alias("at"),
            F.substring(F.col("body"), c["first"] + 1, c["last"] - c["first"] + LENGTH).alias("bytes"),
        ),
    )
    contexts = keep(
        texts.join(listed, ["doc", "tie"], "left_semi")
        .dropDuplicates(["doc", "tie"])
        .join(wanted, ["doc", "tie"])
        .select("doc", "tie", F.explode(cut).alias("c"))
        .select("doc", "tie", "c.*")
        .join(small(crowded), "anchor", "left"),
        "context-bytes",
    )
    sorted_ = (
        contexts.filter("crowded is null")
        .drop("crowded")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_sort_contexts, PLACE)
    )
    strings = contexts.filter("crowded").mapInArrow(
        _all_strings, "h long, g long, doc long, tie long, first int"
    )
    strings = keep(strings, "strings")
    place = F.struct("doc", "tie", "first")
    earliest = keep(strings.groupBy("h", "g").agg(F.min(place).alias("least")), "earliest")
    grouped = (
        strings.join(earliest, ["h", "g"])
        .filter(place > F.col("least"))
        .select("doc", "tie", "first", F.col("first").alias("last"))
    )
    names = ["doc", "tie", "first", "last"]
    return (
        found.filter("repeat").select(*names)
        .union(sorted_out.filter("not open").select(*names))
        .union(sorted_)
        .union(grouped)
    )


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _runs(firsts: pd.Series, lasts: pd.Series) -> pd.Series:
    """Bytes under the strings as [start, end] runs that do not touch."""

    def merge(first: np.ndarray, last: np.ndarray) -> list[list[int]]:
        order = np.argsort(first, kind="stable")
        first, end = first[order], np.maximum.accumulate(last[order] + LENGTH)
        new = np.concatenate([[True], first[1:] > end[:-1]])
        stop = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])
        return np.column_stack([first[new], end[stop]]).tolist()

    return pd.Series([merge(np.asarray(a), np.asarray(b)) for a, b in zip(firsts, lasts)])


@F.pandas_udf(T.BinaryType())
def _kept(bodies: pd.Series, runs: pd.Series) -> pd.Series:
    def cut(body: bytes, gone: np.ndarray) -> bytes:
        at, parts = 0, []
        for start, end in gone:
            parts.append(body[at:start])
            at = end
        return b"".join([*parts, body[at:]])

    return pd.Series([cut(b, r) for b, r in zip(bodies, runs)])


NOWHERE = -(1 << 63)


def remove_repeats(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, removed, kept) for every row: its text without repeated bytes.

    ``removed``: runs of removed bytes as [start, end], ascending, untouching;
    ``kept``: the other bytes, joined. Runs may cut a character.

    * Null text: empty, as are texts of under 100 bytes as far as repeats go.
    * A null id comes before all others. Different texts under one id are
      ordered by their SHA-256; of rows equal in id and text one is the first,
      and the others are repeats of it as a whole.
    * Extra columns are dropped; an empty table gives an empty table.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_).alias("id"),
        F.coalesce(F.col(id_).cast("long"), F.lit(NOWHERE)).alias("doc"),
        F.conv(F.substring(F.sha2(body, 256), 1, 15), 16, 10).cast("long").alias("tie"),
        body.alias("body"),
    )
    found = keep(
        repeated_strings(rows.select("doc", "tie", "body"))
        .groupBy("doc", "tie")
        .agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
        .select("doc", "tie", _runs("firsts", "lasts").alias("removed")),
        "removed",
    )
    places = rows.groupBy("id", "doc", "tie").agg(
        F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("body")).cast("long").alias("n_bytes")
    )
    # One row of equal ones keeps what is first; with 100 bytes or more the others keep nothing.
    whole_run = F.array(F.array(F.lit(0), F.col("n_bytes").cast("int")))
    nothing = F.array().cast("array<array<int>>")
    again = (F.col("copy") > 1) & (F.col("n_bytes") >= LENGTH)
    touched = (
        places.join(found, ["doc", "tie"], "left")
        .filter(F.col("removed").isNotNull() | ((F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .withColumn("removed", F.when(again, whole_run).otherwise(F.coalesce("removed", nothing)))
        .select("id", "doc", "tie", "n_bytes", "removed", (F.col("removed") == whole_run).alias("gone"))
    )
    touched = keep(touched, "runs")
    emptied = touched.filter("gone").select("id", "n_bytes", "removed", F.lit(b"").alias("kept"))
    partly = touched.filter("not gone")
    listed = keep(touched.select("doc", "tie").distinct(), "touched")
    untouched = rows.join(small(listed, LISTED), ["doc", "tie"], "left_anti").select(
        "id",
        F.octet_length("body").cast("long").alias("n_bytes"),
        nothing.alias("removed"),
        F.col("body").alias("kept"),
    )
    of_partly = keep(partly.select("doc", "tie").distinct(), "partly")
    cut = (
        rows.join(small(of_partly, LISTED), ["doc", "tie"], "left_semi")
        .dropDuplicates(["doc", "tie"])
        .select("doc", "tie", "body")
        .join(partly, ["doc", "tie"])
        .select("id", "n_bytes", "removed", _kept("body", "removed").alias("kept"))
    )
    return untouched.union(emptied).union(cut).withColumnRenamed("id", "doc_id")
