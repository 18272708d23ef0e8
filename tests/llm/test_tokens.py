from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spendlens.llm import registry, tokens
from spendlens.llm.text import words

from .conftest import make_docs


def encoding():
    return tokens.load(public_tokenizers.path(registry.TOKENIZER), public_tokenizers.PATTERN)


def plain(rows):
    sums = {}
    for r in rows:
        n, t = sums.get((r.source, r.lang), (0, 0))
        sums[r.source, r.lang] = (n + 1, t + len(encoding().encode_ordinary(r.text or "")))
    return sums


def state(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_query_counts_every_document(spark, small):
    got = registry.op9_token_counts(spark, small).collect()
    assert {r.tokenizer for r in got} == {registry.TOKENIZER}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert {(r.source, r.lang): (r.docs, r.tokens) for r in got} == plain(docs)


def test_odd_rows(spark, odd_docs, no_docs, tables):
    got = registry.op9_token_counts(spark, tables(documents=odd_docs)).collect()
    assert {(r.source, r.lang): (r.docs, r.tokens) for r in got} == plain(odd_docs.collect())
    assert registry.op9_token_counts(spark, tables(documents=no_docs)).count() == 0


@pytest.fixture()
def rollup(spark, tmp_path):
    return tokens.Rollup(spark, str(tmp_path / "rollup"))


def test_deltas_add_up(spark, rollup):
    docs = make_docs(spark, ["a b c", "d", None, "e f"], sources=["x", "x", "y", None])
    assert rollup.totals().count() == 0
    assert rollup.insert("1", docs, "w", words("text"))
    first = {("x", "en", "w"): (2, 4), ("y", "en", "w"): (1, 0), (None, "en", "w"): (1, 2)}
    assert state(rollup) == first
    assert not rollup.insert("1", docs, "w", words("text"))
    assert state(rollup) == first
    ids = spark.createDataFrame([(0,), (0,), (99,)], "doc_id long")
    assert rollup.delete("2", ids)
    assert not rollup.delete("2", ids)
    assert state(rollup) == first | {("x", "en", "w"): (1, 1)}
    moved = make_docs(spark, ["now four words here"], sources=["y"], first=1)
    assert rollup.revise("3", moved, "v2", words("text"))
    assert not rollup.revise("3", moved, "v2", words("text"))
    assert state(rollup) == {("y", "en", "w"): (1, 0), (None, "en", "w"): (1, 2), ("y", "en", "v2"): (1, 4)}
    assert rollup.insert("4", docs.filter("doc_id = 0"), "w", words("text"))
    assert state(rollup)["x", "en", "w"] == (1, 3)


def test_a_batch_that_broke_off_is_not_counted_and_can_be_repeated(spark, rollup, monkeypatch):
    docs = make_docs(spark, ["a b c", "d"])
    rollup.insert("1", docs, "w", words("text"))
    before = state(rollup)

    real = rollup._write
    for broken in ("totals", "entries"):

        def write(df, path, broken=broken):
            if f"/{broken}/" in path:
                raise OSError("lost")
            real(df, path)

        with monkeypatch.context() as m:
            m.setattr(rollup, "_write", write)
            with pytest.raises(OSError, match="lost"):
                rollup.revise("2", docs, "v", F.lit(7))
        assert state(rollup) == before
    assert rollup.revise("2", docs, "v", F.lit(7))
    assert state(rollup) == {("s0", "en", "v"): (1, 7), ("s1", "en", "v"): (1, 7)}
