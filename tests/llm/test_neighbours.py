from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.llm import neighbours, registry

VECTOR = "vec_id long, embedding array<float>, label int"


def by_definition(rows, k=20, step=20):
    own = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        own[i] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(own))
    if not len(ids):
        return {}
    x = np.stack([own[i] for i in ids])
    out = {}
    for q in ids[ids % step == 0]:
        s = x @ own[q]
        out[q] = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def check(got, rows, least=1.0, k=20):
    want = by_definition(rows, k)
    vectors = {i: v for i, v in rows}
    lists = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        lists.setdefault(r.query_id, []).append(r)
    assert lists.keys() == {q for q, w in want.items() if w}
    hits = total = 0
    for q, own in lists.items():
        assert [r["rank"] for r in own] == list(range(1, len(want[q]) + 1))
        assert [(r.score, -r.vec_id) for r in own] == sorted(((r.score, -r.vec_id) for r in own), reverse=True)
        for r in own:
            a, b = (np.array(vectors[i], np.float32).astype(float) for i in (q, r.vec_id))
            assert r.score == pytest.approx(float(a @ b), abs=1e-12)
        hits += len({r.vec_id for r in own} & set(want[q]))
        total += len(want[q])
    assert hits >= least * total
    return hits / max(total, 1)


def test_recall_on_the_sample_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert check(registry.op2_neighbours(spark, sf).collect(), rows, 0.95) >= 0.95


def test_small_tables_are_exact(spark, tables):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(5)], 0) for i in range(90)]
    rows += [(100 + i, rows[7][1], 0) for i in range(60)]  # equal vectors
    rows += [(200, None, 0), (220, [], 0), (240, [0.0] * 5, 0), (260, [1.0, None, 1.0, 1.0, 1.0], 0)]
    rows += [(280, [float("nan")] * 5, 0), (300, [float("inf")] * 5, 0), (None, [1.0] * 5, 0)]
    df = spark.createDataFrame(rows, VECTOR)
    got = registry.op2_neighbours(spark, tables(embeddings=df)).collect()
    check(got, [r[:2] for r in rows])


def test_few_rows(spark, tables):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [3.0, 1.0], 0), (40, [1.0, 2.0], 0)], VECTOR)
    got = registry.op2_neighbours(spark, tables(embeddings=df)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [
        (0, 1, 1, 5.0), (0, 2, 40, 5.0), (40, 1, 0, 5.0), (40, 2, 1, 5.0),
    ]
    for n in (0, 1):
        assert registry.op2_neighbours(spark, tables(embeddings=df.limit(n))).count() == 0
    twice = df.union(df)
    got = registry.op2_neighbours(spark, tables(embeddings=twice)).collect()
    assert len(got) == 4


def unit_rows(x, first=0):
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return [(first + i, [float(c) for c in v], 0) for i, v in enumerate(x)]


def test_one_long_vector_does_not_blur_the_others(spark, tables):
    rows = unit_rows(np.random.default_rng(5).normal(size=(3000, 24)))
    rows[1] = (1, [100 * c for c in rows[1][1]], 0)
    got = registry.op2_neighbours(spark, tables(embeddings=spark.createDataFrame(rows, VECTOR))).collect()
    check(got, [r[:2] for r in rows], 0.95)


def test_thousands_of_near_copies_are_told_apart(spark, tables):
    rng = np.random.default_rng(6)
    near = rng.normal(size=(1, 24)) + 2e-3 * rng.normal(size=(3000, 24))
    rows = unit_rows(np.concatenate([near, rng.normal(size=(600, 24))]))
    got = registry.op2_neighbours(spark, tables(embeddings=spark.createDataFrame(rows, VECTOR))).collect()
    check(got, [r[:2] for r in rows], 0.95)


def test_unequal_lengths(spark, tables):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 64))
    x *= rng.lognormal(0, 0.6, size=(len(x), 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x.astype(np.float32))]
    got = registry.op2_neighbours(spark, tables(embeddings=spark.createDataFrame(rows, VECTOR))).collect()
    check(got, [r[:2] for r in rows], 0.95)


def test_unequal_lengths_beyond_the_heads(spark, tables, monkeypatch):
    """Clusters of near copies of unequal length, with so few heads that most queries must follow the graph."""
    monkeypatch.setattr(neighbours, "HEADS", neighbours.ASKED)
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(120, 32)), 40, axis=0) + 0.3 * rng.normal(size=(4800, 32))
    x *= rng.lognormal(0, 0.6, size=(len(x), 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x.astype(np.float32))]
    got = registry.op2_neighbours(spark, tables(embeddings=spark.createDataFrame(rows, VECTOR))).collect()
    check(got, [r[:2] for r in rows], 0.95)


def test_other_lengths_and_clashing_columns(spark, tables):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)], 0) for i in range(60)]
    odd = [(100 + i, [5.0] * 3, 0) for i in range(21)]
    df = spark.createDataFrame(rows + odd, VECTOR)
    for name in ("node", "other", "score", "id", "asks", "vector", "size", "code", "length", "query"):
        df = df.withColumn(name, F.lit(1))
    got = registry.op2_neighbours(spark, tables(embeddings=df)).collect()
    check(got, [r[:2] for r in rows])


def test_huge_and_tiny_components(spark, tables):
    rows = [(i, [1e30 * (1 + i % 7), 1e-30 * i, 1.0], 0) for i in range(1, 61)]
    got = registry.op2_neighbours(spark, tables(embeddings=spark.createDataFrame(rows, VECTOR))).collect()
    assert len(got) == 3 * 20
    assert all(math.isfinite(r.score) for r in got)
