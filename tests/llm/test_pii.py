from __future__ import annotations

import hashlib
import random
import re


from spendlens.llm import pii, registry

from .conftest import make_docs

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def by_definition(text):
    spans = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), n, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(spans)]


def strings(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def check(rows, texts):
    for r in rows:
        want = by_definition(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(strings(want).encode()).hexdigest(), r
        for k in PLAIN:
            assert r[f"n_{k}"] == sum(w[0] == k for w in want)
        own = [s for s in r.spans.split(",") if s and not s.startswith("term:")]
        assert ",".join(own) == strings(want)


def test_query_agrees_with_the_plain_patterns(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = registry.op3_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    check(rows, {d.doc_id: d.text for d in docs})


def test_odd_strings_agree_with_the_plain_patterns(spark, tables):
    rng = random.Random(5)
    alphabet = "aZ09@@..%+-  ()é\U0001f600\n12345"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [
        "a@b.c%d@e.f",
        "a@b.c..d@e.f-g.h",
        "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 1.2.3",
        "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111114111 4111  1111 1111 1111",
        "x4111111111111111y 0 4111111111111111",
        "+1 (234) 567-8901 ++12345678901 +1234567890123456",
        "1" * 50_000 + "." + "2" * 50_000,
        "a" * 100_000 + "@" + "b" * 1000,
        "4111 1111 1111 1111 " * 2000,
        "9 " * 30_000,
        "+1 " * 20_000,
    ]
    rows = registry.op3_pii(spark, tables(documents=make_docs(spark, texts))).collect()
    check(rows, dict(enumerate(texts)))


def test_terms_that_only_stand_by_an_entity_are_found_and_masked(spark):
    texts = [f"contact kontoinhaber me{i}@mail.example.com about the thing" for i in range(8)]
    texts += ["please contact the other person about a thing"] * 30
    texts += [f"the thing is number {i}\nabout nothing" for i in range(300)]
    docs = make_docs(spark, texts)
    found = pii.find_personal_data(docs).filter("text is not null").collect()
    assert len(found) == 8
    for r in found:
        assert [r.text[t.start : t.end] for t in r.terms] == ["kontoinhaber"]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[3] == "contact  <EMAIL> about the thing"
    assert all(clean[i] == t for i, t in enumerate(texts) if i >= 8)


def test_odd_rows(spark, odd_docs, no_docs, tables):
    rows = registry.op3_pii(spark, tables(documents=odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    assert [r.spans for r in rows if r.doc_id == 8] == ["ip:12:19"]
    clean = pii.sanitise(odd_docs)
    assert clean.columns == odd_docs.columns
    got = {r.doc_id: r.text for r in clean.collect()}
    assert got[8] == "\U0001f600 ünïcode é <IP>"
    assert got[3] is None
    assert got[5] == " \t\n "
    assert registry.op3_pii(spark, tables(documents=no_docs)).count() == 0


def test_no_python_runs(spark, small, capsys):
    registry.op3_pii(spark, small).explain()
    assert "Python" not in capsys.readouterr().out
