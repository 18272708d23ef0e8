from __future__ import annotations

import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from spendlens.llm import registry, sharding


@pytest.mark.parametrize(("n", "bits"), [(1, 3), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_and_moves_by_one_step(spark, n, bits):
    cells = spark.createDataFrame(
        [(list(p),) for p in product(range(1 << bits), repeat=n)], "p array<int>"
    )
    index = sharding.hilbert_index([F.col("p")[i] for i in range(n)], bits)
    path = [r.p for r in cells.withColumn("i", index).orderBy("i").collect()]
    numbers = [r.i for r in cells.select(index.alias("i")).orderBy("i").collect()]
    assert numbers == list(range(1 << (n * bits)))
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(path, path[1:]))


def check(rows, docs):
    assert len(rows) == len(docs)
    sizes, slots = {}, {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < 40
        assert r.law == "bytes"
        assert r.grown_shard is None
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return sizes


def test_query_cuts_equal_bytes(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    rows = registry.op4_sharding(spark, small).collect()
    sizes = check(rows, docs)
    texts = {d.doc_id: (d.text or "").encode() for d in docs}
    for r in rows:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]))
    ideal, largest = sum(sizes.values()) / 40, max(r.size for r in rows)
    assert all(abs(sizes.get(s, 0) - ideal) <= largest for s in range(40))
    # Shards are runs of the curve.
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in rows)


def test_a_hot_cell_is_ordered_slice_by_slice(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_ROWS", 50)
    docs = spark.range(1000).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(3).alias("n")
    )
    placed = sharding.cut_shards(docs, ["source", "n"], F.lit(1), 7, ["doc_id"])
    rows = placed.select("placed.*").collect()
    counts = [sum(r.shard == s for r in rows) for s in range(7)]
    assert max(counts) - min(counts) <= 1
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_filters_on_each_dimension_skip_shards(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("https://host"), F.format_string("%03d", F.col("id") % 100)).alias("source"),
        (F.xxhash64("id") % 1000).alias("n"),
    )
    placed = sharding.cut_shards(docs, ["source", "n"], F.lit(1), 64, ["doc_id"])
    boxes = placed.groupBy("placed.shard").agg(
        F.min("source").alias("s0"), F.max("source").alias("s1"), F.min("n").alias("n0"), F.max("n").alias("n1")
    )
    by_source = boxes.filter("'https://host050' between s0 and s1").count()
    by_n = boxes.filter("500 between n0 and n1").count()
    assert by_source <= 24 and by_n <= 24


def test_odd_rows(spark, odd_docs, no_docs, tables):
    rows = registry.op4_sharding(spark, tables(documents=odd_docs)).collect()
    check(rows, odd_docs.collect())
    assert registry.op4_sharding(spark, tables(documents=no_docs)).count() == 0
    kept = sharding.shard_documents(odd_docs)
    assert kept.columns == [*odd_docs.columns, "placed"]
    assert kept.count() == odd_docs.count()
