from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from spendlens.llm import registry
from spendlens.llm.mixing import mix, shares_by_rank, source_targets

LABEL = "doc_id long, quality int, toxic int"


def targets(sizes):
    """Water filling by the definition: cut, reshare, until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {**share, **capped}
        capped.update({s: 3 * sizes[s] for s in over})


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 1, "c": 1, None: 500},
        {"a": 1000, "b": 10, "c": 5, "d": 7},
        {"a": 5},
        {"a": 0, "b": 4},
        {"a": 7, "b": 7, "c": 7, "d": 7, "e": 7, "f": 7},
    ],
)
def test_targets_are_reshared(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df, shares_by_rank()).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s])


def test_query_meets_targets(spark, small):
    rows = registry.op1_mixing(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    assert {r.doc_id: r.size for r in rows} == words
    sizes = {}
    for r in docs:
        sizes[r.source] = sizes.get(r.source, 0) + words[r.doc_id]
    want = targets(sizes)
    for s, size in sizes.items():
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == size and r.target == pytest.approx(want[s]) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own) / 2 + 1e-6
        # Whole epochs come before the fractional one.
        assert {r.copies for r in own} <= {int(want[s] // size), int(want[s] // size) + 1}
    assert all(r.taken == r.copies * r.size <= 3 * r.size for r in rows)
    again = registry.op1_mixing(spark, small).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_heavier_documents_are_drawn_more_often(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"),
        F.lit(10).alias("n"),
        F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("w"),
    )
    mixed = mix(docs, F.col("n"), F.col("w"), shares_by_rank(), ["doc_id"])
    taken = {
        r.w: r.c
        for r in mixed.filter("source = 'a'").groupBy("w").agg(F.sum("mix.copies").alias("c")).collect()
    }
    # Source a fills 2/3 of itself: with weights 4 and 1 about 930 heavy and 400 light ones.
    assert sum(taken.values()) == pytest.approx(1333, abs=2)
    assert 860 < taken[4.0] < 960


def test_odd_rows(spark, odd_docs, no_docs, tables):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 0, 0), (2, None, None)], LABEL)
    rows = registry.op1_mixing(spark, tables(documents=odd_docs, labels=labels)).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.taken <= 3 * r.size for r in rows)
    assert len({r.copies for r in rows if r.doc_id == 1}) == 1
    assert registry.op1_mixing(spark, tables(documents=no_docs, labels=labels.limit(0))).count() == 0
