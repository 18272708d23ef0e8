from __future__ import annotations

import random
import re

import pytest
import xxhash

from spendlens.llm import registry, simhash
from spendlens.llm.components import components

from .conftest import make_docs


def by_definition(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, near):
    """Index of the first value reachable, for each value."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def within_two(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count() <= 2


def test_query_agrees_with_brute_force(spark, small):
    docs = sorted(spark.read.parquet(f"{small}/documents.parquet").collect(), key=lambda r: r.doc_id)
    fps = [by_definition(r.text) for r in docs]
    roots = classes(fps, within_two)
    want = {
        r.doc_id: (f"{f:016x}", docs[k].doc_id) for r, f, k in zip(docs, fps, roots, strict=True)
    }
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op8_simhash(spark, small).collect()}
    assert got == want


@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_links_of_crowded_fingerprints_are_whole(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.choice([0, 31, 32, 63, rng.randrange(64)])
            fps.add(x)
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.links(nodes)
    for r in edges.collect():
        assert within_two(r.a, r.b)
    got = {r.node: r.root for r in components(edges).collect()}
    want = classes(fps, within_two)
    groups = {}
    for f, k in zip(signed, want, strict=True):
        groups.setdefault(k, set()).add(f)
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_components_of_a_path_a_star_and_loops(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(300, 400)]
    edges = spark.createDataFrame([*path, *star, (7, 7), (9, 8), (9, 8)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 300 for i in range(300, 400)} | {500: 300, 8: 8, 9: 8}
    assert got == want
    assert components(edges.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, base + " more", base.replace("w9 ", "x9 "), "other words here now", None, "", base]
    docs = make_docs(spark, texts, first=10)
    twice = docs.union(docs.filter("doc_id = 10")).union(docs.filter("doc_id = 13"))
    ids = sorted(r.doc_id for r in simhash.one_of_each(twice).collect())
    fps = [by_definition(t) for t in texts]
    assert ids == sorted({10 + k for k in classes(fps, within_two)})


def test_odd_rows(spark, odd_docs, no_docs, tables):
    rows = registry.op8_simhash(spark, tables(documents=odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].component_id == by_id[2].component_id == 1
    assert {by_id[i].fingerprint for i in (3, 4, 5)} == {"0" * 16}
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {3}
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "6", "7", "8", "None"]
    assert registry.op8_simhash(spark, tables(documents=no_docs)).count() == 0
    assert simhash.one_of_each(no_docs).count() == 0
