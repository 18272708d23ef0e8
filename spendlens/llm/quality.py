"""Quality by compression: which dictionary shortens a text more?

Two zstandard dictionaries are trained, one on good and one on bad labelled
texts. A text is cut into pieces so short that the dictionary matters in each
of them; every piece is compressed with both. The difference of the two
total sizes over their sum, put through a logistic curve fitted on labelled
texts that are in neither dictionary, is the score. Nothing but the text goes
into it.

The model is fitted on a bounded sample (``SAMPLE_ROWS`` texts of each label,
of at most ``SAMPLE_CHARS`` characters) and is as small as its dictionaries.
Scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import whole

SAMPLE_ROWS = 3000
SAMPLE_CHARS = 32_768
#: Texts of the sample that train dictionaries; the others fit the curve.
DICTIONARY_SHARE = 0.7
DICTIONARY_BYTES = 65_536
PIECE_BYTES = 512
#: From this score on a text is good.
GOOD = 0.3


def pieces(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]


def train_dictionary(texts: list[str]) -> bytes:
    """Content of a dictionary for ``texts``; plain text if they are too few to train one."""
    samples = [p for t in texts for p in pieces(t) if len(p) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(
        level=3,
        dict_data=data,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )


def size_difference(good: bytes, bad: bytes) -> Callable[[str], float]:
    """Between -1 and 1: how much shorter the good dictionary makes a text; 0 if empty."""
    by_good, by_bad = _compressor(good), _compressor(bad)

    def measure(text: str) -> float:
        parts = pieces(text)
        a = sum(len(by_good.compress(p)) for p in parts)
        b = sum(len(by_bad.compress(p)) for p in parts)
        return (b - a) / (a + b) if parts else 0.0

    return measure


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with a little ridge on the slope."""
    scale = max(float(np.std(x)), 1e-9)
    design = np.column_stack([x / scale, np.ones(len(x))])
    beta = np.zeros(2)
    ridge = np.diag([1e-3, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - ridge @ beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


@dataclass(frozen=True)
class Model:
    """Two dictionaries and a curve; without both labels only the curve's height counts."""

    good: bytes
    bad: bytes
    slope: float
    height: float

    def column(self, text: Column) -> Column:
        model = self

        @F.pandas_udf(T.DoubleType())
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            measure = size_difference(model.good, model.bad)
            for batch in batches:
                x = np.fromiter((measure(t) for t in batch), dtype=float, count=len(batch))
                z = np.clip(model.slope * x + model.height, -30, 30)
                yield pd.Series(1 / (1 + np.exp(-z)))

        return score(whole(text))


def held_out(id_: str = "doc_id") -> Column:
    """Rows no model learns from: a fifth, by the CRC of the id. False for null."""
    crc = F.crc32(F.col(id_).cast("string").cast("binary"))
    return F.coalesce(crc % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model of ``labels.quality`` (1 good, 0 bad) over ``docs.text``.

    Labels of null, held-out or unknown documents, and null labels, are not
    used; of several labels of a document the largest counts. If one label
    has no text, every score is the share of good labels (one half without
    any).
    """
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    share = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    docs = docs.select("doc_id", "text")
    sample: dict[int, list[str]] = {}
    for q in (0, 1):
        drawn = known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id")
        # At most SAMPLE_ROWS ids: a bound on what is broadcast.
        ids = F.broadcast(drawn.limit(SAMPLE_ROWS).select(F.col("doc_id").alias("of")))
        texts = (
            docs.join(ids, F.col("doc_id") == F.col("of"))
            .filter(F.length("text").between(1, SAMPLE_CHARS))
            .select("doc_id", "text")
            .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
            .limit(SAMPLE_ROWS)
        )
        sample[q] = [r.text for r in texts.collect()]
    return fit_texts(sample[1], sample[0], share.get(1, 0), share.get(0, 0))


def fit_texts(good: list[str], bad: list[str], n_good: int, n_bad: int) -> Model:
    """Model from drawn texts; ``n_good`` and ``n_bad`` are the labels they stand for."""
    prior = np.clip((n_good + 1) / (n_good + n_bad + 2), 0.01, 0.99)
    height = float(np.log(prior / (1 - prior)))
    if not good or not bad:
        return Model(b"", b"", 0.0, height)
    cut = {len(t): max(1, int(len(t) * DICTIONARY_SHARE)) for t in (good, bad)}
    dictionaries = [train_dictionary(t[: cut[len(t)]]) for t in (good, bad)]
    # With a text or two of a label, the curve has to use what the dictionary used.
    rest = [t[cut[len(t)] :] or t for t in (good, bad)]
    measure = size_difference(*dictionaries)
    x = np.array([measure(t) for part in rest for t in part])
    y = np.repeat([1.0, 0.0], [len(rest[0]), len(rest[1])])
    per = [n_good / len(rest[0]), n_bad / len(rest[1])]
    weight = np.repeat(per, [len(rest[0]), len(rest[1])])
    slope, height = fit_logistic(x, y, weight / weight.mean())
    return Model(*dictionaries, slope, height)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows of ``docs`` plus ``quality_score``, from 0 (bad) to 1 (good).

    * Columns: one named ``quality_score`` is replaced, all others stay.
    * Null and empty texts get the score of a text that both dictionaries
      shorten alike.
    * Repeated rows get equal scores; an empty table gives an empty table.
    """
    return docs.withColumn("quality_score", model.column(F.col("text")))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that a model fitted on ``labels`` does not reject.

    * All columns stay, whatever their names, and rows as often as they are.
    * Null and empty texts get the score of a text that both dictionaries
      shorten alike; null ids are scored as others are, and never learned from.
    * Without labels every score is one half, and all stay. Empty tables give none.
    """
    scored = docs.select(
        F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"), fit(docs, labels).column(F.col("text")).alias("score")
    )
    return scored.filter(F.col("score") >= GOOD).select("row.*")
