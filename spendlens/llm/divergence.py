"""How far the sources of a language stand apart in the words they use.

Each task folds whole documents into stripes: for a term of a language, the
number of documents it is in and its count per source. Stripes are held in a
hash table, handed on when it has grown to a bound, and shuffled to the task
that merges those of one term, where terms in too few documents go. What a merged stripe holds is
all there is to know about its term, so the tasks that read them emit
divergences at once: of a term in a source against the language, and, summed up
over their terms, of each source against each other one. Only sums per pair of
sources and the first terms of each source per task are shuffled after that.

Counts turn into probabilities in billionths with one added to every count, and
all arithmetic is exact in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import keep

#: Documents of a language that a term must be in.
LEAST_DOCS = 3
SCALE = 1_000_000_000
#: Terms told per source.
TOP = 200
#: Terms a task holds before it hands its stripes on.
HELD = 400_000
#: Cells of all matrices of pair sums that a task holds, 8 bytes each.
CELLS = 4_000_000
#: Terms times sources looked at together.
BLOCK = 500_000

STRIPE = "lang string, term binary, docs long, sources array<string>, counts array<long>"
FOUND = "lang string, source string, part string, item string, value long"

#: Bytes in lower case (A-Z alone), with white space for all that is in no term.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms(text: str) -> list[bytes]:
    """Runs of letters A to Z in any case and of characters beyond ASCII, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


# -- stripes --------------------------------------------------------------------


def _rows(held: dict[str, dict[bytes, tuple]]) -> Iterator[pa.RecordBatch]:
    for lang, own in held.items():
        names = list(own)
        for at in range(0, len(names), 10_000):
            part = names[at : at + 10_000]
            docs, sources, counts, sizes = [], [], [], [0]
            for stripe in map(own.__getitem__, part):
                if type(stripe) is tuple:
                    docs.append(1)
                    sources.append(stripe[0])
                    counts.append(stripe[1])
                else:
                    docs.append(stripe[0])
                    sources.extend(stripe[1])
                    counts.extend(stripe[1].values())
                sizes.append(len(sources))
            bounds = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(part), pa.string()),
                    "term": pa.array(part, pa.binary()),
                    "docs": pa.array(docs, pa.int64()),
                    "sources": pa.ListArray.from_arrays(bounds, pa.array(sources, pa.string())),
                    "counts": pa.ListArray.from_arrays(bounds, pa.array(counts, pa.int64())),
                }
            )


def fold(batches: Iterator[pa.RecordBatch], held_terms: int) -> Iterator[pa.RecordBatch]:
    """Stripes of the documents (lang, source, text) of a task.

    A term of a single document is held as (source, count), any other one as
    its number of documents and a table of counts.
    """
    held: dict[str, dict[bytes, tuple]] = {}
    size = 0
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, batch.column("text")):
            own = held.setdefault(lang, {})
            before = len(own)
            once = (source, 1)
            for term, n in Counter(terms(text.as_py())).items():
                stripe = own.get(term)
                if stripe is None:
                    own[term] = once if n == 1 else (source, n)
                    continue
                if type(stripe) is tuple:
                    own[term] = stripe = [1, {stripe[0]: stripe[1]}]
                stripe[0] += 1
                counts = stripe[1]
                counts[source] = counts.get(source, 0) + n
            size += len(own) - before
            if size >= held_terms:
                yield from _rows(held)
                held, size = {}, 0
    yield from _rows(held)


def merge(stripes: DataFrame, least: int) -> DataFrame:
    """(lang, term, sources, counts) of the terms in ``least`` documents.

    Each task's entries of a source stay apart, at most one per task.
    """
    return (
        stripes.groupBy("lang", "term")
        .agg(
            F.sum("docs").alias("docs"),
            F.flatten(F.collect_list("sources")).alias("sources"),
            F.flatten(F.collect_list("counts")).alias("counts"),
        )
        .filter(F.col("docs") >= least)
        .select("lang", "term", "sources", "counts")
    )


# -- divergences ----------------------------------------------------------------


def portion(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) for count <= total, in steps that don't overflow."""
    step = 32_000
    whole, rest = np.divmod(count * step, total)
    return 1 + whole * (SCALE // step) + rest * (SCALE // step) // total


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


@dataclass
class Lang:
    """Sources of a language in order, their counts over all kept terms, and how many these are."""

    sources: list[str]
    totals: list[int]
    terms: int


class _Audit:
    def __init__(self, langs: dict[str, Lang], top: int) -> None:
        self.langs, self.top = langs, top
        self.place = {k: {s: i for i, s in enumerate(v.sources)} for k, v in langs.items()}
        self.sums: dict[str, np.ndarray] = {}

    def take(self, lang: str, names: list[bytes], stripes: list[tuple[list, list]]) -> Iterator[pa.RecordBatch]:
        known = self.langs[lang]
        place = self.place[lang]
        step = max(1, BLOCK // len(known.sources))
        for at in range(0, len(names), step):
            part = stripes[at : at + step]
            row = np.repeat(np.arange(len(part)), [len(s) for s, _ in part])
            column = np.array([place[s] for stripe, _ in part for s in stripe], np.int64)
            count = np.zeros((len(part), len(known.sources)), np.int64)
            np.add.at(count, (row, column), np.array([c for _, listed in part for c in listed], np.int64))
            totals = np.array(known.totals, np.int64)
            p = portion(count + 1, totals + known.terms)
            q = portion(count.sum(axis=1) + 1, totals.sum() + known.terms)
            yield from self._terms(lang, names[at : at + step], count, p, q)
            yield from self._pairs(lang, p)

    def _terms(self, lang: str, names: list[bytes], count, p, q) -> Iterator[pa.RecordBatch]:
        order = np.empty(len(names), np.int64)
        order[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        row, column = np.nonzero((count > 0) & (p > q[:, None]))
        value = divergence(p[row, column], q[row])
        best = np.lexsort((order[row], -value, column))
        column = column[best]
        first = np.arange(len(best)) - np.searchsorted(column, column) < self.top
        chosen = best[first]
        sources = self.langs[lang].sources
        yield pa.RecordBatch.from_pydict(
            {
                "lang": [lang] * len(chosen),
                "source": pa.array([sources[c] for c in column[first].tolist()], pa.string()),
                "part": pa.array(["term"] * len(chosen), pa.string()),
                "item": pa.array([names[r].decode("utf-8", "replace") for r in row[chosen].tolist()], pa.string()),
                "value": pa.array(value[chosen], pa.int64()),
            }
        ) if len(chosen) else _none()

    def _pairs(self, lang: str, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = p.shape[1]
        if n * n > CELLS:  # too many for a matrix: a source at a time, handed on at once
            for j in range(n):
                yield self._pair_rows(lang, j, divergence(p, p[:, j : j + 1]).sum(axis=0)[:, None])
            return
        if lang not in self.sums:
            if sum(s.size for s in self.sums.values()) + n * n > CELLS:
                yield from self.close()
            self.sums[lang] = np.zeros((n, n), np.int64)
        for j in range(n):
            self.sums[lang][:, j] += divergence(p, p[:, j : j + 1]).sum(axis=0)

    def _pair_rows(self, lang: str, first: int, sums: np.ndarray) -> pa.RecordBatch:
        sources = self.langs[lang].sources
        i, j = np.indices(sums.shape)
        i, j = i.ravel(), j.ravel() + first
        apart = i != j
        return pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([lang] * int(apart.sum()), pa.string()),
                "source": pa.array([sources[k] for k in i[apart].tolist()], pa.string()),
                "part": pa.array(["pair"] * int(apart.sum()), pa.string()),
                "item": pa.array([sources[k] for k in j[apart].tolist()], pa.string()),
                "value": pa.array(sums.ravel()[apart], pa.int64()),
            }
        )

    def close(self) -> Iterator[pa.RecordBatch]:
        for lang, sums in self.sums.items():
            yield self._pair_rows(lang, 0, sums)
        self.sums = {}


def _none() -> pa.RecordBatch:
    names = ["lang", "source", "part", "item"]
    return pa.RecordBatch.from_pydict(
        {n: pa.array([], pa.string()) for n in names} | {"value": pa.array([], pa.int64())}
    )


def emit(batches: Iterator[pa.RecordBatch], langs: dict[str, Lang], top: int) -> Iterator[pa.RecordBatch]:
    """Divergences of merged stripes: the ``top`` terms of each source, and sums per pair of sources."""
    audit = _Audit(langs, top)
    for batch in batches:
        of: dict[str, tuple[list, list]] = {}
        columns = [batch.column(n).to_pylist() for n in ("lang", "term", "sources", "counts")]
        for lang, term, sources, counts in zip(*columns):
            names, stripes = of.setdefault(lang, ([], []))
            names.append(term)
            stripes.append((sources, counts))
        for lang, (names, stripes) in of.items():
            yield from audit.take(lang, names, stripes)
    yield from audit.close()


def audit_sources(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences of each source of a language.

    ``pair``: against each other source of the language, over all terms kept.
    ``term``: of the ``top`` terms that it uses more than the language as a whole.

    * Null text, language and source are read as ''.
    * Repeated rows are documents of their own.
    * Texts of any length are folded whole; those without a term count as
      documents of their source all the same.
    * Ties in value go by the item's UTF-8 bytes.
    * A language without a term in enough documents has pairs of value 0. A
      source that is alone in its language has no pairs.
    * An empty table gives no rows. Other columns are not read.

    The sources of all languages are brought to the driver and to every task:
    the result has a row for each two sources of a language, far more than that.
    """
    read = docs.select(
        F.coalesce(F.col(lang), F.lit("")).alias("lang"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    held = HELD
    stripes = keep(merge(read.mapInArrow(lambda b: fold(b, held), STRIPE), least_docs), "stripes")
    groups = keep(read.select("lang", "source").distinct(), "sources")
    totals = (
        stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
        .groupBy("lang", F.col("c.sources").alias("source"))
        .agg(F.sum("c.counts").alias("n"))
    )
    kept = {r.lang: r["count"] for r in stripes.groupBy("lang").count().collect()}
    langs: dict[str, Lang] = {}
    counted = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    for r in sorted(counted.collect(), key=lambda r: (r.lang, r.source)):
        of = langs.setdefault(r.lang, Lang([], [], kept.get(r.lang, 0)))
        of.sources.append(r.source)
        of.totals.append(r.n)
    found = keep(stripes.mapInArrow(lambda b: emit(b, langs, top), FOUND), "divergences")
    pairs = (
        groups.join(groups.withColumnRenamed("source", "item"), "lang")
        .filter("source <> item")
        .join(
            found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")),
            ["lang", "source", "item"],
            "left",
        )
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")

    def ranked(part: DataFrame) -> DataFrame:
        return part.withColumn("rank", F.row_number().over(order))

    return ranked(pairs).union(ranked(found.filter("part = 'term'")).filter(F.col("rank") <= top))
