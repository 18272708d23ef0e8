from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendlens.llm import registry, scoring

from .conftest import make_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens) and base score of each row, by definition."""
    each = [(r.doc_id, WORD.findall((r.text or "").translate(LOWER)) + [""]) for r in rows]
    c = Counter(t for d, ts in each if not out(d) for t in ts)
    n, v = sum(c.values()), len(c)
    return sorted(
        (
            ((d, out(d), len(ts), sum(c[t] > 0 for t in ts), n),
             sum(math.log10((c[t] + 1) / (n + (v + 1))) for t in ts))
            for d, ts in each
        ),
        key=str,
    )


def result(df):
    got = [((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens), r.base_score, r.score) for r in df.collect()]
    return sorted(got, key=str)


def check(got, rows):
    want = plain(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    for (_, base, score), (_, told) in zip(got, want):
        assert base == pytest.approx(told, rel=1e-9)
        assert score < 0 and math.isfinite(score)


def test_counts_and_base_by_definition(spark, small):
    got = registry.op11_scoring(spark, small)
    rows = got.collect()
    check(result(got), spark.read.parquet(f"{small}/documents.parquet").collect())
    for r in rows:
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / max(r.n_bytes, 1))


def test_odd_rows(spark, odd_docs, no_docs, tables):
    got = result(registry.op11_scoring(spark, tables(documents=odd_docs)))
    check(got, odd_docs.collect())
    assert registry.op11_scoring(spark, tables(documents=no_docs)).count() == 0
    lain = scoring.score_texts(odd_docs, scoring.held_out())
    assert lain.select("row.*").columns == odd_docs.columns


def test_nothing_to_learn_from(spark):
    docs = make_docs(spark, ["some words", "other words words"])
    rows = scoring.score_texts(docs, F.lit(True)).select("scored.*").collect()
    assert {(r.train_tokens, r.n_known, r.base_score) for r in rows} == {(0, 0, 0.0)}
    assert all(r.score < -1 for r in rows)


TEXTS = ["the river runs to the sea and the sea takes the river", "a stone lies near the river bank"] * 40


def test_scores_do_not_depend_on_partitions_or_slices(spark, monkeypatch):
    docs = make_docs(spark, [f"{t} number {i}" for i, t in enumerate(TEXTS)])
    want = result(scoring.score_texts(docs, scoring.held_out()).select("row.*", "scored.*"))
    got = result(scoring.score_texts(docs.repartition(13), scoring.held_out()).select("row.*", "scored.*"))
    for a, b in zip(got, want):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-9)


def test_held_out_texts_are_not_learned_from(spark):
    docs = make_docs(spark, TEXTS)
    ids = [i for i in range(len(TEXTS)) if out(i)]
    other = make_docs(spark, [("zyx " * 9 if i in ids[1:] else t) for i, t in enumerate(TEXTS)])
    scores = [
        {g[0][0]: g[2] for g in result(scoring.score_texts(d, scoring.held_out()).select("row.*", "scored.*"))}
        for d in (docs, other)
    ]
    for i in range(len(TEXTS)):
        if i not in ids[1:]:
            assert scores[0][i] == pytest.approx(scores[1][i], rel=1e-9)


def test_language_is_told_from_noise_and_unseen_words_from_unlike_ones(spark):
    ids = [i for i in range(400) if out(i)][:4]
    texts = [TEXTS[i % 2] + f" rivers{'abc'[i % 3]}" for i in range(400)]
    probes = ["the river runs to the sea", "xq jzvk wpq mlkq zzxq qqj wk", "the rivering stones", "the qzxvkjpq wjzkqx"]
    for i, t in zip(ids, probes):
        texts[i] = t
    got = {g[0][0]: g[2] for g in result(scoring.score_texts(make_docs(spark, texts), scoring.held_out()).select("row.*", "scored.*"))}
    a, b, c, d = (got[i] / len(t) for i, t in zip(ids, probes))
    assert a > b + 0.3
    assert c > d + 0.2


def _model(words):
    counts = np.zeros(2 * scoring._offsets()[-1], np.int64)
    batch = pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "c": pa.array([1] * len(words), pa.int64())})
    for b in scoring.add_blocks(iter(list(scoring.count_bits(iter([batch, batch]))))):
        step = 2 << scoring.BLOCK_BITS
        part = np.frombuffer(b.column("counts")[0].as_py(), np.int64)
        counts[b.column("block")[0].as_py() * step :][: len(part)] = part
    return counts.reshape(-1, 2), scoring.learn(counts.reshape(-1, 2), words)


def test_bits_are_a_distribution_and_counts_are_those_of_the_words():
    words = [w.encode() for w in "the then there river rivers stone stones sea seas a an and".split()]
    counts, model = _model(words)
    slots, bits, word = scoring.word_bits(words)
    for k in range(len(scoring.TABLES)):
        plain = Counter((int(s), int(b)) for s, b in zip(slots[:, :, k].ravel(), bits.ravel()))
        assert all(counts[s, b] == 2 * n for (s, b), n in plain.items())
    # Over all next bytes, the space included, a word's beginning has probability one.
    for begun in (b"", b"ri", b"ston", b"zz"):
        whole = model.word_logs([begun + bytes([b]) for b in range(256) if b != 0x20])
        after = [model.word_logs([begun + bytes([b])])[0] for b in (0x61, 0x74)]
        assert whole[0x61 - 1 + (0x61 <= 0x20)] == pytest.approx(after[0])
        slots, bits, _ = scoring.word_bits([begun + bytes([b]) for b in range(256)])
        at = np.cumsum([len(begun) + 2] * 256) - 2  # the byte after the beginning
        known = model.odds[slots[at]]
        z = (known * model.weights[scoring._gates(known)]).sum(axis=2)
        p = 1 / (1 + np.exp(np.where(bits[at] == 1, -z, z)))
        assert p.prod(axis=1).sum() == pytest.approx(1, abs=1e-5)


def test_refined_weights_look_back_only_and_stay_a_distribution():
    rng = np.random.default_rng(1)
    n = 50
    ways = rng.dirichlet(np.ones(3), size=(n, 3))  # of three words, by three ways, at each token
    said = rng.integers(0, 3, n)
    logs = np.log(np.array([ways[t, :, said[t]] for t in range(n)]))
    for at in (0, 7, 8, 31, 49):
        sums = []
        for w in range(3):
            own = logs[: at + 1].copy()
            own[at] = np.log(ways[at, :, w])
            sums.append(scoring.refined(own, np.array([0, at + 1]))[0])
        before = scoring.refined(logs[:at], np.array([0, at]))[0] if at else 0.0
        assert np.exp(np.array(sums) - before).sum() == pytest.approx(1)
    both = scoring.refined(np.concatenate([logs, logs[:9]]), np.array([0, n, n + 9]))
    assert both == pytest.approx([scoring.refined(logs, np.array([0, n]))[0], scoring.refined(logs[:9], np.array([0, 9]))[0]])


def test_very_small_probabilities_have_no_floor():
    logs = np.array([[-1e6, -np.inf, -np.inf]] * 9)
    assert scoring.refined(logs, np.array([0, 9]))[0] == pytest.approx(-9e6, rel=1e-5)


def test_what_came_before():
    codes = np.array([4, 4, 2, 4, 2, 4, 4])
    doc = np.array([0, 0, 0, 0, 1, 1, 1])
    assert scoring.earlier(codes, doc).tolist() == [0, 1, 0, 2, 0, 0, 1]


def test_documents_are_scored_alike_however_many_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = [1, 5, 300, 2, 1, 77, 40, 1]
    docs = [
        {"row": {"doc_id": i}, "held_out": i % 2 == 0, "n_bytes": 9 * n,
         "codes": scoring._planes(rng.integers(0, 50, n).astype(np.int32))}
        for i, n in enumerate(sizes)
    ]
    known = [{"pos": i, "c": int(rng.integers(0, 9)), "coded": -1.0 - i} for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"docs": pa.array([docs]), "known": pa.array([known])})

    def scores(span):
        monkeypatch.setattr(scoring, "SPAN", span)
        found = list(scoring._score(iter([batch]), 200, 40))
        return len(found), [r for b in found for r in b.to_pylist()]

    once, whole = scores(1 << 40)
    pieces, parts = scores(48)
    assert once == 1 and pieces == 6
    assert parts == whole
    assert [r["scored"]["n_tokens"] for r in whole] == sizes


def test_weights_are_learned_from_every_whole_word(spark, monkeypatch):
    # A sample of words, and the first bytes of each, decided before.
    looked_at = []
    docs = make_docs(spark, [" ".join(f"w{i:05d}x{'y' * 70}{i % 7}" for i in range(a, a + 700)) for a in range(0, 21_000, 700)])
    learn = scoring.learn_from

    def watched(counts, words):
        looked_at.append(words)
        model = learn(counts, words)
        told = scoring.learn(counts, [bytes(r.word) for r in words.collect()])
        assert np.allclose(model.weights, told.weights, atol=1e-4)
        return model

    monkeypatch.setattr(scoring, "learn_from", watched)
    scoring.score_texts(docs, F.lit(False))
    (words,) = looked_at
    assert words.count() == 21_001
    assert words.agg(F.max(F.octet_length("word"))).first()[0] == 78


def test_derivatives_add_up_and_point_uphill():
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 103, rng.integers(1, 9)).tolist()) for _ in range(200)]
    counts = np.zeros((scoring._offsets()[-1], 2))
    slots, bits, _ = scoring.word_bits(words)
    np.add.at(counts, (slots, bits[:, :, None]), 1)
    weights = np.full((8 * (len(scoring.TABLES) + 1), len(scoring.TABLES)), 0.2)
    whole = scoring.slopes(counts, weights, words)
    assert np.allclose(whole, scoring.slopes(counts, weights, words[:70]) + scoring.slopes(counts, weights, words[70:]))

    def fit(w):
        one = (bits == 1)[:, :, None]
        both = counts[slots]
        known = scoring.odds(np.maximum(both[..., 0] - ~one, 0), np.maximum(both[..., 1] - one, 0)).astype(float)
        z = (known * w[scoring._gates(known)]).sum(axis=2)
        return -np.logaddexp(0, np.where(bits == 1, -z, z)).sum()

    for g, i in ((5, 0), (40, 3), (47, 4)):
        step = np.zeros_like(weights)
        step[g, i] = 1e-4
        assert (fit(weights + step) - fit(weights - step)) / 2e-4 == pytest.approx(whole[g, i, 0], rel=1e-3, abs=1e-3)


def _shared_words():
    rng = np.random.default_rng(7)
    words = [bytes(rng.integers(97, 100, rng.integers(0, 9)).tolist()) for _ in range(300)]
    words += [b"abab" * 90 + bytes([97 + i % 9, 0xFF - i]) for i in range(40)]
    return words + [b"", "ünïcode".encode(), "ünïform".encode(), b"x" * 70_000, b"x" * 70_001]


def _beginnings(words):
    return {(w + b" ")[: i + 1] for w in words for i in range(len(w) + 1)}


def test_beginnings_of_words_in_order_are_looked_at_once():
    words = sorted(_shared_words())
    told = scoring._Bytes(words)
    at, order, start = told.beginnings()
    whole = [words[told.word[i]] + b" " for i in at]
    met = Counter(w[: told.place[i] + 1] for w, i in zip(whole, at) if len(w) < 1000)
    short = [w for w in words if len(w) < 1000]
    assert set(met) == _beginnings(short) and max(met.values()) == 1
    often = Counter((w + b" ")[: i + 1] for w in short for i in range(len(w) + 1))
    for i, w, n in zip(at, whole, np.diff(start, append=len(order))):
        assert len(w) > 1000 or n == often[w[: told.place[i] + 1]]
    assert sorted(order) == list(range(len(told.flat)))


def test_shared_beginnings_change_no_result():
    words = [w for w in _shared_words() if len(w) < 1000]
    counts, model = _model(words)
    weights = model.weights.astype(float)
    logs = [model.word_logs([w])[0] for w in words]
    left = scoring.without_one(counts)
    sums = sum(scoring._slopes(left, weights, [w]) for w in words)
    slots, bits, _ = scoring.word_bits(words)
    plain = np.zeros_like(counts)
    np.add.at(plain, (slots, bits[:, :, None]), 2)
    assert np.array_equal(plain, counts)
    for some in (sorted(words), words, words[::-1]):
        assert np.array_equal(_model(some)[0], counts)
        by_word = dict(zip(some, model.word_logs(some)))
        assert [by_word[w] for w in words] == pytest.approx(logs, rel=1e-6)
        assert np.allclose(scoring._slopes(left, weights, some), sums)


def test_words_come_in_order(spark, monkeypatch):
    listed = []
    learn = scoring.learn_from

    def watched(counts, words):
        listed.append([r.word for r in words.coalesce(1).collect()])
        return learn(counts, words)

    monkeypatch.setattr(scoring, "learn_from", watched)
    scoring.score_texts(make_docs(spark, [" ".join(f"w{i * 7919 % 5000}" for i in range(5000))]).coalesce(1), F.lit(False))
    (words,) = listed
    falls = sum(bytes(a) > bytes(b) for a, b in zip(words, words[1:]))
    assert len(words) == 5001 and falls < 50
