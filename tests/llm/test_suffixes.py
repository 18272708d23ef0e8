from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from spendlens.llm import registry, suffixes

from .conftest import make_docs


def by_definition(rows):
    """Removed flags per row, rows being in order; every 100-byte string is looked up."""
    seen, out = set(), []
    for body in rows:
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - 99):
            s = hashlib.md5(body[i : i + 100]).digest()
            if s in seen:
                gone[i : i + 100] = True
            seen.add(s)
        out.append(gone)
    return out


def digest(body, gone):
    edges = np.diff(np.concatenate([[0], gone.astype(int)]))
    kept = bytes(np.frombuffer(body, np.uint8)[~gone]) if len(body) else b""
    return len(body), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()


def expected(docs):
    rows = sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()))
    bodies = [(r.text or "").encode() for r in rows]
    return sorted((str(r.doc_id), *digest(b, g)) for r, b, g in zip(rows, bodies, by_definition(bodies)))


def found(rows):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_suffixes_are_ordered(seed):
    rng = random.Random(seed)
    n = rng.randint(3, 400)
    s = np.array([rng.randint(0, rng.choice([1, 3, 200])) for _ in range(n)])
    if seed % 2:
        s = np.tile(s, 3)
    for need in (2, 7, 100, len(s)):
        order = np.argsort(suffixes.rank_suffixes(s, need), kind="stable")
        heads = [tuple(s[i : i + need]) for i in order]
        assert heads == sorted(heads)


def passages(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(rng.randint(10, 90)) for _ in range(6)]
    texts = []
    for _ in range(70):
        parts = [say(rng.randint(0, 60)) if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randint(0, 5))]
        texts.append(rng.choice([" ", "\n", ""]).join(parts))
    for _ in range(15):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, 3)):
            if t:
                t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t))
    texts += ["ab" * 400, "a" * 500, "a" * 99, "a" * 100, None, "", texts[0], texts[0]]
    return texts


@pytest.mark.parametrize(("seed", "block", "gather"), [(1, None, None), (2, 3000, 50), (3, 300, 7)])
def test_query_agrees_with_brute_force(spark, tables, monkeypatch, seed, block, gather):
    if block:
        # Read by the driver and passed with the functions, which tests do not import anew.
        monkeypatch.setattr(suffixes, "BLOCK", block)
    docs = make_docs(spark, passages(seed))
    got = registry.op10_suffixes(spark, tables(documents=docs)).collect()
    assert found(got) == expected(docs.collect())


def test_functions_of_tasks_agree_whatever_the_blocks(monkeypatch):
    import pyarrow as pa

    texts = [t.encode() for t in passages(5) if t and len(t.encode()) >= 100]
    want = by_definition(texts)

    def run(gather, block, rows):
        monkeypatch.setattr(suffixes, "GATHER", gather)
        monkeypatch.setattr(suffixes, "BLOCK", block)
        n = len(texts)
        half = n // 2
        tasks = []
        for a, b in ((0, half), (half, n)):
            tasks.append(pa.RecordBatch.from_pydict({"doc": list(range(a, b)), "tie": [0] * (b - a), "body": texts[a:b]}))
        t = pa.Table.from_batches([x for task in tasks for x in suffixes._find_anchors(iter([task]))])
        gone = [np.zeros(len(x), bool) for x in texts]

        def mark(table):
            for d, a, b in zip(table["doc"].to_pylist(), table["first"].to_pylist(), table["last"].to_pylist()):
                gone[d][a : b + 100] = True

        mark(t.filter(t["repeat"]))
        rest = t.filter(pa.compute.invert(t["repeat"])).drop(["repeat"])
        rest = rest.sort_by([(c, "ascending") for c in ("anchor", "context", "doc", "tie", "first")])
        out = list(suffixes._sort_out(iter(rest.to_batches(max_chunksize=rows))))
        if out:
            o = pa.Table.from_batches(out)
            mark(o.filter(pa.compute.invert(o["open"])))
            left = o.filter(o["open"]).sort_by("anchor")
            bodies = [texts[d][a : b + 100] for d, a, b in zip(left["doc"].to_pylist(), left["first"].to_pylist(), left["last"].to_pylist())]
            left = left.append_column("bytes", pa.array(bodies, pa.binary()))
            for batch in suffixes._sort_contexts(iter(left.to_batches(max_chunksize=rows))):
                mark(pa.Table.from_batches([batch]))
        return gone

    for sizes in ((10**6, 1_500_000, 10_000), (10, 2_000, 3), (1, 20_000, 1)):
        got = run(*sizes)
        assert all((a == b).all() for a, b in zip(got, want)), sizes


def test_sample_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = registry.op10_suffixes(spark, small).collect()
    assert found(got) == expected(docs.collect())


def test_odd_rows(spark, odd_docs, no_docs, tables):
    long = make_docs(spark, ["q" * 50 + "once more, " * 30] * 2, first=1).select("doc_id", "text", "lang", "source", "n_chars")
    docs = odd_docs.select(*long.columns).union(long).union(long)
    got = registry.op10_suffixes(spark, tables(documents=docs)).collect()
    assert found(got) == expected(docs.collect())
    assert registry.op10_suffixes(spark, tables(documents=odd_docs)).count() == odd_docs.count()
    assert registry.op10_suffixes(spark, tables(documents=no_docs)).count() == 0
