"""From raw documents to shards of training data.

Every stage takes (session, documents, folder of the tables). All but the last
return documents with the columns they came with; ``run`` writes what a stage
returns to the folder all executors share, and the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import decontam, mixing, quality, sharding, simhash
from spendlens.llm.store import keep
from spendlens.llm.text import letter_share, words


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row(docs: DataFrame) -> Column:
    """All columns in a struct, where no name of an operator's own can clash with theirs."""
    return F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row")


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts; see ``quality.good_documents`` for odd rows."""
    return quality.good_documents(docs, _table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; see ``simhash``."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no question of the benchmark; see ``decontam.clean_documents``."""
    return decontam.clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's weight asks for, with some none.

    All columns stay, whatever their names; null texts have no words and are
    taken as often as others without words. An empty table gives none.
    """
    rows = docs.select(_row(docs), "doc_id", "source", "text", "n_chars")
    mixed = mixing.mix(
        rows, words("text"), letter_share("text"), mixing.shares_by_rank(), ["doc_id", "n_chars"]
    )
    copies = F.explode(F.array_repeat(F.lit(0), F.col("mix.copies").cast("int")))
    return mixed.select("row", copies).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard, slot in the shard and index on the curve.

    These three replace columns of the same names; all others stay. Null and
    empty texts have a size of their own; an empty table gives none.
    """
    kept = [n for n in docs.columns if n not in ("shard", "slot", "curve")]
    placed = sharding.shard_documents(docs.select(*(F.col(f"`{n}`") for n in kept)))
    return placed.select(*(F.col(f"`{n}`") for n in kept), "placed.shard", "placed.slot", "placed.curve")


STAGES = [
    ("quality classifier", reject_bad),
    ("near copies", drop_copies),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: Compressed sizes have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
