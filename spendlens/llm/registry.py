"""The registered queries: each applies one operator to its whole table.

They only derive the columns of the result; the work is in the operators.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontam, divergence, mixing, neighbours, pii, quality, sharding
from . import scoring, simhash, suffixes, tokens
from .store import folder, keep
from .text import whole, words

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = keep(docs.select("doc_id", "source", words("text").alias("words")), "words")
    sized = keep(mixing.labelled_weight(sized, table(spark, sf_dir, "labels")), "weights")
    mixed = mixing.mix(
        sized, F.col("words"), F.col("weight"), mixing.shares_by_rank(), ["doc_id"]
    )
    return mixed.select("doc_id", "source", "mix.*")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, columns=["doc_id"])

    def count(nth: int) -> Column:
        return F.size(F.filter("base", lambda s: s["nth"] == nth)).cast("long")

    return found.select(
        "row.doc_id",
        *(count(n).alias(f"n_{k}") for n, k in enumerate(pii.KINDS)),
        F.sha2(pii.span_strings(F.col("base")), 256).alias("base_sha256"),
        pii.span_strings(pii.all_spans(F.col("base"), F.col("terms"))).alias("spans"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = whole("text")
    docs = keep(
        table(spark, sf_dir, "documents").select(
            "doc_id",
            "source",
            "lang",
            "n_chars",
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        ),
        "sizes",
    )
    placed = sharding.cut_shards(
        docs, ["source", "lang", "n_chars"], F.col("size"), 40, ["doc_id", "text_crc32"]
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "placed.shard",
        "placed.slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "placed.curve",
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame(
        [(-1, 0, "user", hard), (-1, 1, "assistant", hard)],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_turns(turns.union(added)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    found = decontam.contaminated(docs, items)
    return found.select("doc_id", "item_id", "windows", "found", "containment", "kind", "start")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        quality.held_out().alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.GOOD).cast("int").alias("predicted"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = simhash.near_copies(docs, columns=["doc_id"])
    return marked.select(
        "doc_id",
        F.lower(F.lpad(F.hex("near.fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("near.component").alias("component_id"),
    )


TOKENIZER = "byte_bpe_50k.tiktoken"


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents counted by words on arrival, then revised to a tokenizer's counts."""
    docs = table(spark, sf_dir, "documents")
    rollup = tokens.Rollup(spark, folder(spark, "token-counts"))
    rollup.insert("arrived", docs, "words", words("text"))
    count = tokens.token_count(
        F.col("text"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN
    )
    for _ in range(2):  # as after a retry: the second commit finds the first
        rollup.revise("tokenized", docs, TOKENIZER, count)
    return rollup.totals()


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score_texts(table(spark, sf_dir, "documents"), scoring.held_out(), columns=["doc_id"])
    return scored.select("row.doc_id", "scored.*")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents")
    lain = alignment.align(docs, *paths, public_tokenizers.PATTERN, columns=["doc_id"])
    return lain.select("row.doc_id", "aligned.*")


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_neighbours": op2_neighbours,
    "op3_pii": op3_pii,
    "op4_sharding": op4_sharding,
    "op5_chat": op5_chat,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_suffixes": op10_suffixes,
    "op11_scoring": op11_scoring,
    "op12_divergence": op12_divergence,
    "op13_alignment": op13_alignment,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL: dict[str, str] = {
    "op12_divergence": rf"""
with doc as (
    select row_number() over () as nth, coalesce(lang, '') as lang, coalesce(source, '') as source,
           coalesce(text, '') as text
    from documents),
used as (
    select nth, lang, source, translate(term, '{_UPPER}', '{_UPPER.lower()}') as term
    from (select nth, lang, source,
                 unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
          from doc)),
kept as (select lang, term from used group by lang, term having count(distinct nth) >= 3),
size as (select d.lang, count(k.term) as v
         from (select distinct lang from doc) d left join kept k using (lang) group by d.lang),
cell as (
    select g.lang, g.source, k.term, count(u.nth) as n
    from (select distinct lang, source from doc) g
    join kept k using (lang)
    left join used u on u.lang = g.lang and u.source = g.source and u.term = k.term
    group by g.lang, g.source, k.term),
mass as (select lang, source, sum(n) as total from cell group by lang, source),
own as (
    select lang, source, term, n,
           (1 + (1000000000::hugeint * (n + 1)) // (total + v)::hugeint)::bigint as p
    from cell join mass using (lang, source) join size using (lang)),
common as (
    select c.lang, c.term,
           (1 + (1000000000::hugeint * (c.n + 1)) // (m.total + v)::hugeint)::bigint as q
    from (select lang, term, sum(n) as n from cell group by lang, term) c
    join (select lang, sum(total) as total from mass group by lang) m using (lang)
    join size using (lang)),
apart as (
    select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
    from own a join own b on a.lang = b.lang and a.term = b.term and a.source <> b.source
    group by a.lang, a.source, b.source),
told as (
    select g.lang, g.source, 'pair' as part, h.source as item, coalesce(value, 0)::bigint as value
    from (select distinct lang, source from doc) g
    join (select distinct lang, source from doc) h on g.lang = h.lang and g.source <> h.source
    left join apart a on a.lang = g.lang and a.source = g.source and a.item = h.source
    union all
    select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint
    from own join common using (lang, term) where n > 0 and p > q)
select * from (
    select lang, source, part, item, value,
           row_number() over (partition by lang, source, part order by value desc, item)::integer as rank
    from told)
where part = 'pair' or rank <= 200
""",
}
