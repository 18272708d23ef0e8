"""The pipeline against a plain version of every stage, each on its own input."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spendlens.llm import quality

from .test_mixing import targets
from .test_simhash import by_definition, classes, within_two

SF = "/root/testdata/sf0.01"


def grams(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, SF), name.replace(" ", "-"))
        found.append(docs.collect())
    return found


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_stages_keep_the_columns_of_documents(outputs):
    names = list(outputs[0][0].asDict())
    for rows in outputs[1:-1]:
        assert list(rows[0].asDict()) == names
    assert list(outputs[-1][0].asDict()) == [*names, "shard", "slot", "curve"]


def test_quality(spark, outputs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    measure = quality.size_difference(model.good, model.bad)
    good = [r for r in outputs[0] if model.slope * measure(r.text or "") + model.height >= -0.8472978603872037]
    assert ids(good) == ids(outputs[1])
    bad = {r.doc_id for r in labels.groupBy("doc_id").agg(F.max("quality").alias("q")).collect() if r.q == 0}
    left = set(ids(outputs[1])) & bad
    assert len(left) < 0.2 * len(bad)


def test_near_copies(outputs):
    rows = sorted(outputs[1], key=lambda r: r.doc_id)
    roots = classes([by_definition(r.text) for r in rows], within_two)
    assert ids(outputs[2]) == sorted({rows[k].doc_id for k in roots})


def test_decontamination(spark, outputs):
    asked = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = []
    for r in outputs[2]:
        own = grams(r.text)
        if not any(len(g & own) >= 0.8 * len(g) for g in asked):
            clean.append(r)
    assert ids(clean) == ids(outputs[3])
    assert len(clean) < len(outputs[2])


def test_mixing(outputs):
    sizes, largest, taken = {}, {}, {}
    for r in outputs[3]:
        sizes[r.source] = sizes.get(r.source, 0) + n_words(r.text)
        largest[r.source] = max(largest.get(r.source, 0), n_words(r.text))
    for r in outputs[4]:
        taken[r.source] = taken.get(r.source, 0) + n_words(r.text)
    for s, want in targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= largest[s] / 2 + 1e-6
    whole = {str(r) for r in outputs[3]}
    assert {str(r) for r in outputs[4]} <= whole


def test_sharding(outputs):
    placed = outputs[5]
    assert ids(placed) == ids(outputs[4])
    size, slots = {}, {}
    for r in placed:
        size[r.shard] = size.get(r.shard, 0) + len((r.text or "").encode()) + 16
        slots.setdefault(r.shard, []).append(r.slot)
    largest = max(len((r.text or "").encode()) + 16 for r in placed)
    assert all(abs(size.get(s, 0) - sum(size.values()) / 40) <= largest for s in range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_take_odd_rows_and_none(spark, odd_docs, no_docs, tables):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, "no id here")], "item_id long, text string")
    sf = tables(documents=odd_docs, labels=labels, benchmark=bench)
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == docs.columns
            assert stage(spark, docs, sf).count() <= 3 * docs.count()
    spaced = odd_docs.drop("shard", "slot", "curve")
    assert corpus_pipeline.shard(spark, spaced, sf).count() == odd_docs.count()
    sf = tables(documents=spaced)
    assert corpus_pipeline.run(spark, sf).count() > 0
