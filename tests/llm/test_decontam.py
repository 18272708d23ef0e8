from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from spendlens.llm import decontam, registry

from .conftest import make_docs

QUESTION = (
    "A train leaves the old station at Dover with 120 passengers. "
    "After 3 hours it has gone 240 km and 45 passengers leave. "
    "How far, in the same 3 hours, would a train with 120 passengers go at half the speed?"
)
FILLER = "Many words stand around this passage, and none of them has to do with it at all. "


def items(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def found(docs, bench):
    return {(r.doc_id, r.item_id): r.kind for r in decontam.contaminated(docs, bench).collect()}


def test_templates_keep_their_tokens_with_and_without_values(spark):
    df = spark.createDataFrame([(QUESTION,), ("5% of 7kg ### @x ~ Über 3 Ärzte",), ("",)], "t string")
    rows = df.select(
        decontam.template(F.col("t")).alias("a"), decontam.template(F.col("t"), True).alias("b")
    ).collect()
    for r in rows:
        assert [x if x[0] not in "#@~" else x[0] for x in r.b] == r.a
    assert rows[0].a[:12] == "a train leaves the old station at @ with # passengers after".split()
    assert "~km~" in rows[0].b and "#240#" in rows[0].b
    assert rows[1].b[:5] == ["#5#", "~%~", "of", "#7#", "~kg~"]


def test_query_agrees_with_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()

    def grams(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    asked = {b.item_id: grams(b.text) for b in bench}
    want = set()
    for d in docs:
        own = grams(d.text)
        want |= {(d.doc_id, i) for i, g in asked.items() if len(g & own) >= 0.8 * len(g)}
    got = {(r.doc_id, r.item_id) for r in registry.op6_decontamination(spark, sf).collect()}
    assert want
    assert got == want


def test_reparameterised_questions_are_caught_and_inconsistent_ones_are_not(spark):
    other = (
        QUESTION.replace("120", "77").replace("Dover", "Leeds").replace("3 hours", "9 minutes")
        .replace("240 km", "13 miles").replace("45", "8")
    )
    mixed = other.replace("with 77 passengers go", "with 99 passengers go")
    docs = make_docs(
        spark,
        [FILLER + QUESTION + FILLER, FILLER + other, mixed, QUESTION.lower(), FILLER * 3, QUESTION[:120], None],
    )
    got = found(docs, items(spark, QUESTION, FILLER * 2 + "and something else entirely here"))
    assert got.pop((0, 0)) == "verbatim"
    assert got.pop((1, 0)) == "reparameterised"
    assert (2, 0) not in got
    assert (5, 0) not in got
    assert {d for d, i in got if i == 0} <= {3}


def test_clean_documents_stay(spark):
    docs = make_docs(spark, [FILLER + QUESTION, FILLER, None, "", FILLER + QUESTION])
    twice = docs.union(docs.filter("doc_id in (1, 4)"))
    kept = decontam.clean_documents(twice, items(spark, QUESTION))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 2, 3]


def test_a_shuffled_benchmark_gives_the_same(spark, monkeypatch):
    docs = make_docs(spark, [FILLER + QUESTION, FILLER])
    bench = items(spark, QUESTION)
    want = found(docs, bench)
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 1)
    assert found(docs, bench) == want == {(0, 0): "verbatim"}


def test_odd_rows(spark, odd_docs, no_docs, tables):
    bench = items(spark, "one two three four five six", "", None, "no id here", "1 2 3 4 5 6 7")
    bench = bench.union(bench).union(spark.createDataFrame([(None, "wörd " * 9)], bench.schema))
    for name in ("size", "pos", "window", "n"):
        bench = bench.withColumn(name, F.lit(1))
    got = registry.op6_decontamination(spark, tables(documents=odd_docs, benchmark=bench)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 0), (2, 0), (None, 3), (6, None)}
    assert len(got) == 4
    empty = tables(documents=no_docs, benchmark=bench)
    assert registry.op6_decontamination(spark, empty).count() == 0
    empty = tables(documents=odd_docs, benchmark=bench.limit(0))
    assert registry.op6_decontamination(spark, empty).count() == 0


def test_copies_in_other_case_and_spacing_are_found(spark):
    texts = [QUESTION.lower(), QUESTION.upper(), QUESTION.replace(" ", "  "), QUESTION.replace(" ", "\u00a0")]
    got = found(make_docs(spark, [FILLER + t for t in texts]), items(spark, QUESTION))
    assert set(got) == {(i, 0) for i in range(4)}


def test_renamed_persons_at_the_start_of_sentences_are_found(spark):
    asked = (
        "Anna has 12 red apples in May. Anna gives 5 of them to Bob. Anna buys 7 green apples from Carla. "
        "How many apples does Anna have now, if Bob and Carla eat none of theirs?"
    )
    other = asked
    for a, b in (("Anna", "Mira"), ("Bob", "Tom"), ("Carla", "Ruth"), ("12", "31"), ("5", "8"), ("7", "9")):
        other = other.replace(a, b)
    got = found(make_docs(spark, [FILLER + other + FILLER]), items(spark, asked))
    assert got == {(0, 0): "reparameterised"}


def test_an_edited_mention_and_values_that_become_equal_are_no_veto(spark):
    edited = QUESTION.replace("with 120 passengers go", "with 99 passengers go")
    equal = (
        QUESTION.replace("120", "45").replace("Dover", "Leeds").replace("3 hours", "9 minutes")
        .replace("240 km", "13 miles")
    )
    got = found(make_docs(spark, [FILLER + edited, FILLER + equal]), items(spark, QUESTION))
    assert got == {(0, 0): "edited", (1, 0): "reparameterised"}


def test_numbers_alone_tell_the_kind_of_a_copy(spark):
    same = QUESTION.replace("120", "7").replace("45", "8")
    mixed = QUESTION.replace("with 120 passengers.", "with 7 passengers.").replace("120 passengers go", "999 passengers go")
    mixed = mixed.replace("After 3 hours", "After 9 hours").replace("same 3 hours", "same 4 hours")
    docs = make_docs(spark, [FILLER + t + FILLER for t in (same, mixed, QUESTION.upper(), mixed.upper())])
    got = found(docs, items(spark, QUESTION))
    assert got == {(0, 0): "reparameterised", (1, 0): "edited", (2, 0): "verbatim", (3, 0): "edited"}


def test_no_document_is_lost_by_the_words_that_tell(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    asked = [r.text for r in bench.limit(15).collect()]
    rng = random.Random(2)
    texts = []
    for t in asked * 12:
        words = t.split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            k = rng.randrange(len(words))
            words[k] = rng.choice(["Xenia", "42", words[k].upper(), "McDonald", words[k] + "  ", "other"])
        texts.append(FILLER + " ".join(words) + FILLER)
    docs = make_docs(spark, texts).unionByName(spark.read.parquet(f"{sf}/documents.parquet").limit(150))

    def pairs():
        return sorted(tuple(r) for r in decontam.contaminated(docs, bench).collect())

    got = pairs()
    assert len(got) > 50
    monkeypatch.setattr(decontam, "candidates", lambda docs, body, told: docs)
    assert pairs() == got


def test_documents_without_a_telling_word_are_not_read(spark):
    docs = make_docs(spark, ["Other words stood here.", QUESTION, "nothing of all this"]).select("doc_id", F.col("text").alias("body"))
    told = decontam._told(items(spark, QUESTION), "item_id", "text")
    kept = decontam.candidates(docs, F.col("body"), told)
    assert [r.doc_id for r in kept.collect()] == [1]
