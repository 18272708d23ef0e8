from __future__ import annotations

import zlib

import numpy as np
import pytest

from spendlens.llm import quality, registry

from .conftest import make_docs

LABEL = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = registry.op7_quality(spark, sf).toPandas()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= 0.3)).all()
    held = rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    assert (rows.held_out == held).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").max("quality").toPandas()
    both = rows[rows.held_out].merge(labels, on="doc_id")
    y, s = both["max(quality)"].to_numpy(), both.score.to_numpy()
    assert (both.predicted == y).mean() > 0.95
    good, bad = s[y == 1], s[y == 0]
    assert np.mean(good[:, None] > bad[None, :]) > 0.95
    # Calibrated: the mean score is the share of good texts.
    assert s.mean() == pytest.approx(y.mean(), abs=0.03)


def test_the_score_depends_on_the_text_alone(spark):
    texts = ["the cat sat on the mat and was happy " * 3, "### $$$ %%% &&& *** " * 5] * 40
    docs = make_docs(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(80)], LABEL)
    model = quality.fit(docs, labels)
    other = make_docs(spark, texts, sources=["z"] * 80, langs=["q"] * 80, first=1000)
    got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    moved = {r.doc_id: r.quality_score for r in quality.score(other, model).collect()}
    assert [got[i] for i in range(80)] == [moved[1000 + i] for i in range(80)]
    assert all(got[i] > 0.5 > got[i + 1] for i in range(0, 80, 2))
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 80, 2))


def test_labels_that_say_little(spark, odd_docs):
    docs = make_docs(spark, ["a b", "c d", None])
    none = spark.createDataFrame([], LABEL)
    assert {r.quality_score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, 1, 0), (1, None, 0), (77, 1, 0), (1, 9, 0)], LABEL)
    assert quality.score(docs, quality.fit(docs, nulls)).count() == 3
    few = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 0, 0), (7, 0, 0)], LABEL)
    model = quality.fit(odd_docs, few)
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r.quality_score <= 1 for r in rows)
    assert {r["key"] for r in rows} == {"x"}


def test_empty_tables(spark, no_docs, odd_docs, tables):
    none = spark.createDataFrame([], LABEL)
    assert registry.op7_quality(spark, tables(documents=no_docs, labels=none)).count() == 0
    assert registry.op7_quality(spark, tables(documents=odd_docs, labels=none)).count() == odd_docs.count()
