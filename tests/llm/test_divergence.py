from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from spendlens.llm import divergence, registry

from .conftest import make_docs

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, top=200):
    """All rows of the audit, by definition."""
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        found = Counter(t.translate(LOWER) for t in TERM.findall(r.text or ""))
        df[lang].update(set(found))
        counts[lang, source].update(found)
    out = set()
    for lang in df:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        groups = sorted(s for k, s in counts if k == lang)

        def p(count, total, kept=kept):
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        whole = Counter()
        for s in groups:
            whole.update({t: counts[lang, s][t] for t in kept})
        own = {s: p(counts[lang, s], sum(counts[lang, s][t] for t in kept)) for s in groups}
        q = p(whole, sum(whole.values()))
        for s in groups:
            pairs = [(sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o) for o in groups if o != s]
            terms = [
                ((own[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and own[s][t] > q[t]
            ]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda v: (-v[0], v[1].encode()))
                for rank, (value, item) in enumerate(items[: top if part == "term" else None], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_query_by_definition_and_by_sql(spark, small):
    got = registry.op12_divergence(spark, small)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = rows_of(got)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert rows == plain(docs.collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{small}/documents.parquet'")
    assert rows == set(con.sql(registry.SQL["op12_divergence"]).fetchall())


def test_odd_rows(spark, odd_docs, no_docs, tables):
    got = rows_of(registry.op12_divergence(spark, tables(documents=odd_docs)))
    assert got == plain(odd_docs.collect())
    assert ("", "", "pair") not in {r[:3] for r in got}  # alone in its language
    assert registry.op12_divergence(spark, tables(documents=no_docs)).count() == 0


def test_stripes_handed_on_early_and_wide_tables_give_the_same(spark, monkeypatch):
    texts = ["Über alles und ueber das das", "das Ende, das ALLES war", "x1y2z das alles", None, "", "1 2 3"]
    docs = make_docs(spark, texts * 6, sources=[f"q{i % 9}" for i in range(36)], langs=["de"] * 36)
    want = plain(docs.collect())
    monkeypatch.setattr(divergence, "HELD", 2)
    assert rows_of(divergence.audit_sources(docs)) == want
    batches = list(_batches(docs))
    for cells in (1, 100, 10**6):
        monkeypatch.setattr(divergence, "CELLS", cells)
        monkeypatch.setattr(divergence, "BLOCK", 20)
        langs = _langs(docs)
        rows = spark.createDataFrame(
            [r for b in divergence.fold(iter(batches), 10) for r in b.to_pylist()], divergence.STRIPE
        )
        stripes = [pa.RecordBatch.from_pylist([r.asDict() for r in divergence.merge(rows, 3).collect()])]
        sums = Counter()
        for b in divergence.emit(iter(stripes), langs, 200):
            for r in b.to_pylist():
                if r["part"] == "pair":
                    sums[r["source"], r["item"]] += r["value"]
        assert sums == Counter({(r[1], r[3]): r[4] for r in want if r[2] == "pair"})


def _batches(docs):
    rows = docs.select("lang", "source", "text").na.fill("").orderBy("lang").collect()
    yield pa.RecordBatch.from_pylist([r.asDict() for r in rows])


def _langs(docs):
    out = {}
    rows = docs.collect()
    df = Counter(t for r in rows for t in set(TERM.findall((r.text or "").translate(LOWER))))
    kept = {t for t, n in df.items() if n >= 3}
    for s in sorted({r.source for r in rows}):
        of = out.setdefault("de", divergence.Lang([], [], len(kept)))
        of.sources.append(s)
        found = [t for r in rows if r.source == s for t in TERM.findall((r.text or "").translate(LOWER))]
        of.totals.append(sum(t in kept for t in found))
    return out


@pytest.mark.parametrize("total", [1, 7, 10**9, 10**13 + 7])
def test_portions_are_exact(total):
    counts = np.array([0, 1, total // 3, total - 1, total], np.int64)
    got = divergence.portion(counts, np.array(total, np.int64))
    assert got.tolist() == [1 + 10**9 * int(c) // total for c in counts]


def test_a_source_with_a_third_of_all_rows(spark):
    texts = [f"word{i % 7}a common Term" for i in range(90)]
    docs = make_docs(spark, texts, sources=["hot" if i % 3 == 0 else f"s{i % 11}" for i in range(90)])
    assert rows_of(divergence.audit_sources(docs.repartition(16))) == plain(docs.collect())
