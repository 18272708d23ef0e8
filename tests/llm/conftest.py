from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, texts, sources=None, langs=None, first=0):
    """Documents numbered from ``first``."""
    rows = [
        (
            first + i,
            t,
            langs[i] if langs else "en",
            sources[i] if sources else f"s{i % 3}",
            len(t) if t is not None else None,
        )
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, "one two three four five six", "en", "a", 27),
        (1, "one two three four five six", "en", "a", 27),
        (2, "one two three four five six", "en", None, 27),
        (3, None, None, None, None),
        (None, "no id here", "de", "b", 10),
        (None, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\n ", "en", "b", 4),
        (6, "wörd " * 40_000, "de", "a", 200_000),
        (7, "x" * 150_000, "en", "c", 150_000),
        (8, "\U0001f600 ünïcode é 1.2.3.4", "fr", "c", 22),
    ]
    docs = spark.createDataFrame(rows, DOC)
    clashing = (
        "row size weight taken copies shard slot curve key at score n h fp hash pos path words "
        "tokens id node component block label quality"
    ).split()
    for name in clashing:
        docs = docs.withColumn(name, F.lit("x"))
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture()
def tables(spark, tmp_path):
    """Writes tables where a registered query reads them."""

    def write(**frames):
        for name, df in frames.items():
            df.coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
