"""Token counts kept up to date by signed deltas.

A batch of inserts, deletes or revised counts becomes signed entries per
document, and their sums by source, language and tokenizer version. Totals are
the sum of the deltas of all committed batches, so they never need a recount,
and deltas can be added in any order.

A batch is committed once its sums carry Spark's success mark, and a committed
batch is not written again. One that broke off has no mark: it is not read, and
a rerun replaces it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import whole

KEYS = ("source", "lang", "tokenizer")
ENTRY = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> tiktoken.Encoding:
    """A byte-pair vocabulary in the tiktoken format, once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str, pattern: str) -> Column:
    """Tokens of a text; 0 for null. ``path`` must exist on every worker."""

    # Texts are taken out of the Arrow buffer one by one: a worker holds no second copy.
    @F.arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = load(path, pattern)
        for batch in batches:
            yield pa.array([len(encoding.encode_ordinary(t.as_py())) for t in batch], pa.int64())

    return count(whole(text))


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _committed(self) -> list[str]:
        """Batches with a success mark: names only, one per batch."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals/*/_SUCCESS")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getParent().getName() for s in fs.globStatus(path) or [])

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{part}/{b}" for b in self._committed()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def entries(self) -> DataFrame:
        """Signed entries of all committed batches."""
        return self._read("entries", ENTRY)

    def current(self) -> DataFrame:
        """What each document counts now."""
        return (
            self.entries()
            .groupBy("doc_id", *KEYS)
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .filter((F.col("docs") != 0) | (F.col("tokens") != 0))
        )

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of all groups that count something."""
        return (
            self._read("totals", ENTRY.partition(", ")[2])
            .groupBy(*KEYS)
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .filter((F.col("docs") != 0) | (F.col("tokens") != 0))
        )

    def _commit(self, batch: str, entries: DataFrame) -> bool:
        written = f"{self.folder}/entries/{batch}"
        self._write(entries, written)
        sums = (
            self.spark.read.schema(ENTRY)
            .parquet(written)
            .groupBy(*KEYS)
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        )
        self._write(sums, f"{self.folder}/totals/{batch}")
        return True

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)

    def insert(self, batch: str, docs: DataFrame, tokenizer: str, tokens: Column) -> bool:
        """Count documents (doc_id, source, lang and what ``tokens`` reads). False if done before.

        Every row counts, repeated ones too. Null ids, sources and languages
        count under null; a null count is 0.
        """
        return batch not in self._committed() and self._commit(batch, _added(docs, tokenizer, tokens))

    def delete(self, batch: str, ids: DataFrame) -> bool:
        """Take back all that the documents in ``ids`` (doc_id) count. False if done before.

        Unknown ids change nothing; null takes back what counts under null.
        """
        return batch not in self._committed() and self._commit(batch, self._taken_back(ids))

    def revise(self, batch: str, docs: DataFrame, tokenizer: str, tokens: Column) -> bool:
        """Replace all that the documents count by new counts. False if done before."""
        if batch in self._committed():
            return False
        added = _added(docs, tokenizer, tokens)
        return self._commit(batch, self._taken_back(docs.select("doc_id")).union(added))

    def _taken_back(self, ids: DataFrame) -> DataFrame:
        own = ids.select(F.col("doc_id").alias("of")).distinct()
        return (
            self.current()
            .join(own, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
            .select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        )


def _added(docs: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        "lang",
        F.lit(tokenizer).alias("tokenizer"),
        F.lit(1).cast("long").alias("docs"),
        F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"),
    )
