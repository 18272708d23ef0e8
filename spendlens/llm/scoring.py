"""Probability of texts by logistic mixing of hashed contexts.

A text is its tokens: words in lower case (A-Z), then an end. A word is coded
bit by bit, a space after it. For every bit several predictors look up, in
tables hashed by their context (the last 1, 2, 3 or 5 bytes of the word, or
all of it so far) and the bits of the byte so far, how often training words had
a 0 or a 1 there. The logarithms of these odds are combined by weights, chosen
by a gate: the place of the bit and how many predictors know their context. The
weights are learned by Newton's method from every distinct training word, each
being left out of the counts that predict it.

A document then refines this as it is read: the coded word, the word's share of
all training words and its share of the document so far are mixed by weights
that follow, block after block, what predicted the document best.

Tasks get words in order. Bytes that a word shares with the beginning of the one
before it have the same contexts, so their bits are looked at once, for the counts,
the weights and the coding of words alike.

What is gathered grows with the corpus: one row for every distinct word. The
tables of bits have a fixed size (``TABLES``), so they are broadcast; words
themselves are counted and their counts brought to the documents by shuffles.
Documents are handled in slices of a bounded size, as lists of word numbers, so
counts are brought once per slice and distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import keep
from .text import whole

#: Bytes of context and bits of the table's size; 0 bytes: all of the word so far.
TABLES = ((1, 16), (2, 18), (3, 19), (5, 20), (0, 20))
BLOCK_BITS = 13
#: Bytes of the texts of a slice; a longer document is a slice of its own.
SLICE = 12_000_000
#: Bytes of word numbers (four each) of the documents that are scored together.
SPAN = 1_000_000
#: Bytes of words whose bits are looked at together.
TOGETHER = 40_000
#: Passes over the training words in which the weights are learned.
PASSES = 2
#: Pull of the weights towards equal ones, where few bits tell.
PRIOR = 16.0
#: Added to both counts of a context.
SMALL = 0.4
#: Tokens of a document between two changes of its weights.
REFINE = 8
#: Weights of coded word, share of training words and share of the document at the start.
FIRST = (0.25, 0.65, 0.10)
#: Share of the weights that is dealt anew at each change.
RETURN = 0.02
SPACE = 0x20

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def held_out(id_: str = "doc_id") -> Column:
    """Documents nothing is learned from: a seventh, by the CRC of the id. False for null."""
    crc = F.crc32(F.col(id_).cast("string").cast("binary"))
    return F.coalesce(crc % 7 == 2, F.lit(False))


# -- bits -----------------------------------------------------------------------


def _offsets() -> list[int]:
    return np.concatenate([[0], np.cumsum([1 << bits for _, bits in TABLES])]).tolist()


class _Bytes:
    """The bytes of words, a space after each, and where a beginning of a word is met first.

    A word's bytes up to where it parts from the word before it have that one's contexts
    and bits, so they need no second look: of words in order, most bytes are shared.
    """

    def __init__(self, words: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join([w + b" " for w in words]), np.uint8)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.first = np.cumsum(self.sizes) - self.sizes
        self.word = np.repeat(np.arange(len(words)), self.sizes)
        self.place = np.arange(len(self.flat)) - self.first[self.word]

    def beginnings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(at, order, start): the byte that ends each beginning where it is met first, all bytes
        in order of their beginnings, and where in this order each beginning starts."""
        before = np.concatenate([[0], self.sizes[:-1]])[self.word]
        same = self.place < before
        same[same] = self.flat[same] == self.flat[np.flatnonzero(same) - before[same]]
        parted = np.minimum.reduceat(np.where(same, len(self.flat), self.place), self.first)
        # Of all bytes of one place, those of a beginning follow each other.
        place = self.place.astype(np.uint16) if self.sizes.max() <= 1 << 16 else self.place
        order = np.argsort(place, kind="stable")
        start = np.flatnonzero((self.place >= parted[self.word])[order])
        return order[start], order, start

    def bits(self, at: np.ndarray) -> np.ndarray:
        """(byte, bit): the bits of the bytes ``at``."""
        return (self.flat[at].astype(np.int64)[:, None] >> (7 - np.arange(8))) & 1

    def slots(self, at: np.ndarray) -> Iterator[np.ndarray]:
        """(byte, bit): each predictor's slots for the bytes ``at``."""
        value = self.flat.astype(np.uint64) + np.uint64(1)
        # Sums of bytes times powers, less the sum before the word, tell a word's beginnings apart.
        power = np.cumprod(np.full(int(self.sizes.max(initial=0)) + 1, _M2, np.uint64))
        run = np.concatenate([[np.uint64(0)], np.cumsum(value * power[self.place], dtype=np.uint64)])[:-1]
        begun = (run - run[self.first][self.word])[at]
        shift = np.arange(8)
        node = ((1 << shift) | (self.flat[at].astype(np.int64)[:, None] >> (8 - shift))).astype(np.uint64) * _M3
        place = self.place[at]
        before = np.zeros(len(at), np.uint64)
        back, offset = 0, _offsets()
        for k, (reach, size) in enumerate(TABLES):
            while back < reach:
                back += 1
                before = before * np.uint64(257) + np.where(place >= back, value[np.maximum(at - back, 0)], np.uint64(0))
            context = before if reach else begun
            mixed = ((context * _M1 + np.uint64(k + 1)) * _M2)[:, None] ^ node
            mixed ^= mixed >> np.uint64(32)
            mixed *= _M1
            mixed >>= np.uint64(64 - size)
            yield mixed.view(np.int64) + offset[k]


def word_bits(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, bits, word): for each byte of each word and the space after it, the slots of
    all predictors (byte, bit, predictor), its bits (byte, bit) and whose it is."""
    told = _Bytes(words)
    every = np.arange(len(told.flat))
    return np.stack(list(told.slots(every)), axis=2), told.bits(every), told.word


def _portions(words: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for at, w in enumerate(words):
        if size and size + len(w) > TOGETHER:
            yield start, at
            start, size = at, 0
        size += len(w) + 1
    if words:
        yield start, len(words)


def count_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of 0 and 1 per slot over a task's words (word, c), in blocks of slots."""
    total = _offsets()[-1]
    counts = np.zeros(2 * total, np.int64)
    for batch in batches:
        words = batch.column("word").to_pylist()
        n = batch.column("c").to_numpy()
        for start, end in _portions(words):
            told = _Bytes(words[start:end])
            at, order, begin = told.beginnings()
            weight = np.repeat(np.add.reduceat(n[start:end][told.word[order]], begin), 8)
            bits = told.bits(at)
            for slots in told.slots(at):
                np.add.at(counts, (2 * slots + bits).ravel(), weight)
    yield from _blocks(counts)


def _blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = 2 << BLOCK_BITS
    for b in range(0, len(counts), step):
        part = counts[b : b + step]
        if part.any():
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([b // step], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())}
            )


def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of one number, of rows sorted by it; one block is held at a time."""
    number, held = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"block": pa.array([number], pa.int32()), "counts": pa.array([held.tobytes()], pa.binary())}
        )

    for batch in batches:
        for b, data in zip(batch.column("block").to_pylist(), batch.column("counts")):
            part = np.frombuffer(data.as_buffer(), np.int64)
            if b != number:
                if held is not None:
                    yield done()
                number, held = b, part.copy()
            else:
                held += part
    if held is not None:
        yield done()


def odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the odds of a 1; 0 where nothing is known."""
    return np.log((ones + SMALL) / (zeros + SMALL)).astype(np.float32)


def without_one(counts: np.ndarray) -> np.ndarray:
    """(slot, bit): odds where a word with this bit is not there to predict it."""
    zeros, ones = counts[:, 0], counts[:, 1]
    return np.stack([odds(np.maximum(zeros - 1, 0), ones), odds(zeros, np.maximum(ones - 1, 0))], axis=1)


def _gates(known: np.ndarray) -> np.ndarray:
    """Number of the weights to use, of (byte, bit, predictor) odds."""
    return np.arange(8)[None, :] * (len(TABLES) + 1) + (known != 0).sum(axis=2)


@dataclass
class Model:
    """Odds of a 1 per slot, and a row of weights per gate."""

    odds: np.ndarray
    weights: np.ndarray

    def word_logs(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of each word's probability as coded."""
        out = np.zeros(len(words))
        for start, end in _portions(words):
            told = _Bytes(words[start:end])
            at, order, begin = told.beginnings()
            bits = told.bits(at)
            known = np.stack([self.odds[slots] for slots in told.slots(at)])
            gate = _gates(np.moveaxis(known, 0, 2))
            z = sum(x * w[gate] for x, w in zip(known, self.weights.T))
            # log p of a 1 is -log(1 + exp(-z)), of a 0 -log(1 + exp(z)).
            cost = np.logaddexp(0, np.clip(np.where(bits == 1, -z, z), -30, 30)).sum(axis=1)
            each = np.repeat(cost, np.diff(begin, append=len(order)))
            out[start:end] = -np.bincount(told.word[order], weights=each, minlength=end - start)
        return out


def slopes(counts: np.ndarray, weights: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Sums over the bits of ``words``, per gate: first and second derivatives by the weights.

    (gate, predictor, 1 + predictors): a column of the slope of the log probability, then
    its curvature, negated.
    """
    return _slopes(without_one(counts), weights, words)


def _slopes(left: np.ndarray, weights: np.ndarray, words: list[bytes]) -> np.ndarray:
    """``slopes``, given the odds ``without_one`` of all slots."""
    gates, n = weights.shape
    out = np.zeros((gates, n, 1 + n))
    left = left.ravel()
    for start, end in _portions(words):
        told = _Bytes(words[start:end])
        at, order, begin = told.beginnings()
        bits = told.bits(at)
        known = np.stack([left[2 * slots + bits] for slots in told.slots(at)])
        gate = _gates(np.moveaxis(known, 0, 2)).astype(np.uint8).ravel()
        often = np.repeat(np.diff(begin, append=len(order)), 8)
        # Bits of one gate side by side, so that each gate's sums are products of matrices.
        side = np.argsort(gate, kind="stable")
        known, y, often = known.reshape(n, -1)[:, side], bits.ravel()[side], often[side]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=gates))])
        for g in np.flatnonzero(np.diff(bounds)):
            of = slice(bounds[g], bounds[g + 1])
            x = known[:, of].astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(weights[g] @ x, -30, 30)))
            out[g, :, 0] += x @ (often[of] * (y[of] - p))
            out[g, :, 1:] += (x * (often[of] * p * (1 - p))) @ x.T
    return out


def _equal() -> np.ndarray:
    return np.full((8 * (len(TABLES) + 1), len(TABLES)), 1.0 / len(TABLES))


def _moved(weights: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Weights after a step of Newton's method, by the sums of ``slopes``."""
    slope = total[:, :, 0] - PRIOR * (weights - _equal())
    curvature = total[:, :, 1:] + PRIOR * np.eye(len(TABLES))
    return weights + np.linalg.solve(curvature, slope[:, :, None])[:, :, 0]


def learn(counts: np.ndarray, words: list[bytes]) -> Model:
    """The model of bit counts (slot, bit), with weights learned from ``words``."""
    weights, left = _equal(), without_one(counts)
    for _ in range(PASSES):
        weights = _moved(weights, _slopes(left, weights, words))
    return Model(odds(counts[:, 0], counts[:, 1]), weights.astype(np.float32))


def learn_from(counts: np.ndarray, words: DataFrame) -> Model:
    """``learn`` over a table of words: tasks sum the derivatives, the driver gets the sums."""
    left = words.sparkSession.sparkContext.broadcast(without_one(counts.astype(np.float32)))
    weights = _equal()
    shape = (*weights.shape, 1 + len(TABLES))
    for _ in range(PASSES):

        def sums(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                total += _slopes(left.value, weights, batch.column("word").to_pylist())
            place = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict(
                {"place": pa.array(place, pa.int32()), "part": pa.array(total.ravel()[place], pa.float64())}
            )

        total = np.zeros(np.prod(shape))
        for r in words.mapInArrow(sums, "place int, part double").groupBy("place").agg(F.sum("part").alias("s")).collect():
            total[r.place] = r.s
        weights = _moved(weights, total.reshape(shape))
    left.destroy()
    return Model(odds(counts[:, 0], counts[:, 1]), weights.astype(np.float32))


# -- documents ------------------------------------------------------------------


def tokens(text: str) -> list[bytes]:
    """Words with A-Z in lower case, then the end, which is the empty word."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() + [b""]


class _Numbers(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def _planes(codes: np.ndarray) -> bytes:
    """Codes as their lower halves, then their upper ones, which are mostly zero and pack well."""
    return codes.view(np.uint16).reshape(-1, 2).T.tobytes()


def _joined(planes: pa.BinaryScalar) -> np.ndarray:
    halves = np.frombuffer(planes.as_buffer(), np.uint16).reshape(2, -1)
    return np.ascontiguousarray(halves.T).view(np.int32).ravel()


def _slice_type(row: T.DataType) -> T.StructType:
    fields = [("row", row), ("held_out", T.BooleanType()), ("n_bytes", T.LongType()), ("codes", T.BinaryType())]
    doc = T.StructType([T.StructField(n, t) for n, t in fields])
    word = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])
    fields = [("slice", T.LongType()), ("docs", T.ArrayType(doc)), ("words", T.ArrayType(word))]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (row, held_out, text) as word numbers, and each slice's words with their
    occurrences in documents to learn from."""
    place = TaskContext.get().partitionId() << 32
    number = _Numbers()
    docs: list[tuple[np.ndarray, bool, int]] = []
    rows: list[pa.Array] = []
    held = done = 0

    def one(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def close() -> pa.RecordBatch:
        learned = [c for c, out, _ in docs if not out]
        n = np.bincount(np.concatenate([np.empty(0, np.int32), *learned]), minlength=len(number))
        words = [pa.array(list(number), pa.binary()), pa.array(n, pa.int64())]
        columns = [
            pa.concat_arrays(rows),
            pa.array([out for _, out, _ in docs], pa.bool_()),
            pa.array([size for *_, size in docs], pa.int64()),
            pa.array([_planes(c) for c, *_ in docs], pa.binary()),
        ]
        fields = ["row", "held_out", "n_bytes", "codes"]
        return pa.RecordBatch.from_pydict(
            {
                "slice": pa.array([place + done], pa.int64()),
                "docs": one(pa.StructArray.from_arrays(columns, fields)),
                "words": one(pa.StructArray.from_arrays(words, ["word", "n"])),
            }
        )

    for batch in batches:
        row, first = batch.column("row"), 0
        for at, (text, out) in enumerate(zip(batch.column("text"), batch.column("held_out").to_pylist())):
            size = len(text.as_buffer())
            if held and held + size > SLICE:
                rows.append(row.slice(first, at - first))
                yield close()
                number, docs, rows, held, done, first = _Numbers(), [], [], 0, done + 1, at
            listed = tokens(text.as_py())
            docs.append((np.fromiter(map(number.__getitem__, listed), np.int32, len(listed)), out, size))
            held += size + 1
        rows.append(row.slice(first))
    if docs:
        yield close()


def earlier(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each token came before in its document; ``doc`` goes up."""
    # Word number and place in one number each, whose order is that of both.
    low = max(len(codes) - 1, 0).bit_length()
    both = np.sort(codes.astype(np.int64) << low | np.arange(len(codes)))
    order = both & ((1 << low) - 1)
    c, d = both >> low, doc[order]
    new = np.ones(len(codes), bool)
    new[1:] = (c[1:] != c[:-1]) | (d[1:] != d[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))
    out = np.empty(len(codes), np.int64)
    out[order] = np.arange(len(codes)) - first
    return out


def refined(logs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of log probabilities of each document, given those of its tokens by each of three ways.

    ``logs``: (token, way), minus infinity where a way knows nothing; the first
    way always knows. Weights start as ``FIRST`` in each document and follow it
    in blocks of ``REFINE`` tokens: what a block says changes the weights of
    the next ones only.
    """
    sizes = np.diff(bounds)
    out = np.zeros(len(sizes))
    order = np.argsort(-sizes, kind="stable")
    start, left = bounds[:-1][order], sizes[order]
    weight = np.tile(np.array(FIRST), (len(sizes), 1))
    # Shares relative to the best way's, which may be too small for a double itself.
    best = logs.max(axis=1, initial=-np.inf)
    shares = np.exp(logs - best[:, None])
    at = 0
    while len(left) and left[0] > at:
        # Documents are in order of length: those that go on come first.
        going = int(np.searchsorted(-left, -at, side="left"))
        weight = weight[:going]
        index = start[:going, None] + at + np.arange(REFINE)
        inside = at + np.arange(REFINE) < left[:going, None]
        index = np.minimum(index, len(shares) - 1)
        p = shares[index]
        mixed = np.einsum("btk,bk->bt", p, weight)
        out[order[:going]] += np.where(inside, np.log(mixed) + best[index], 0).sum(axis=1)
        # The mean share of each way in what the block's tokens got, as in a step of EM.
        part = p * weight[:, None, :] / mixed[:, :, None]
        mean = np.where(inside[:, :, None], part, 0).sum(axis=1) / inside.sum(axis=1)[:, None]
        weight = (1 - RETURN) * (0.7 * weight + 0.3 * mean) + RETURN * np.array(FIRST)
        at += REFINE
    return out


_LONG, _DOUBLE = T.LongType(), T.DoubleType()
_FIELDS = [("held_out", T.BooleanType())]
_FIELDS += [(n, _LONG) for n in ("n_tokens", "n_known", "train_tokens")]
_FIELDS += [("base_score", _DOUBLE), ("score", _DOUBLE), ("n_bytes", _LONG), ("bits_per_byte", _DOUBLE)]
SCORED = T.StructType([T.StructField(n, t) for n, t in _FIELDS])


def _spans(docs: pa.StructArray) -> Iterator[pa.StructArray]:
    """A slice's documents, some at a time: some 160 bytes per token are at work at once."""
    first = held = 0
    for at, size in enumerate(pa.compute.binary_length(docs.field("codes")).to_pylist()):
        if held and held + size > SPAN:
            yield docs.slice(first, at - first)
            first, held = at, 0
        held += size
    yield docs.slice(first)


def _score(batches: Iterator[pa.RecordBatch], total: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """Scores of the documents of slices whose words' counts and logs are given in order."""
    for batch in batches:
        for r in range(batch.num_rows):
            docs = batch.column("docs")[r].values
            known = batch.column("known")[r].values
            c = known.field("c").to_numpy()
            coded = known.field("coded").to_numpy()
            base = np.log10((c + 1.0) / (total + (distinct + 1)))
            with np.errstate(divide="ignore"):
                share = np.log(c / max(total, 1))
            for some in _spans(docs):
                parts = [_joined(b) for b in some.field("codes")]
                codes = np.concatenate(parts)
                sizes = np.array([len(p) for p in parts])
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                doc = np.repeat(np.arange(len(parts)), sizes)
                place = np.arange(len(codes)) - bounds[doc]
                with np.errstate(divide="ignore"):
                    ways = [coded[codes], share[codes], np.log(earlier(codes, doc) / np.maximum(place, 1))]
                score = refined(np.stack(ways, axis=1), bounds) / np.log(10)
                n_bytes = some.field("n_bytes").to_numpy()
                columns = {
                    "held_out": some.field("held_out"),
                    "n_tokens": sizes,
                    "n_known": np.bincount(doc, weights=c[codes] > 0, minlength=len(parts)).astype(np.int64),
                    "train_tokens": np.full(len(parts), total),
                    "base_score": np.bincount(doc, weights=base[codes], minlength=len(parts)),
                    "score": score,
                    "n_bytes": n_bytes,
                    "bits_per_byte": -score * np.log2(10) / np.maximum(n_bytes, 1),
                }
                scored = pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], list(columns))
                yield pa.RecordBatch.from_pydict({"row": some.field("row"), "scored": scored})


def score_texts(
    docs: DataFrame, learned_not: Column, text: str = "text", columns: list[str] | None = None
) -> DataFrame:
    """(row, scored): every row of ``docs`` and the log10 probability of its text's tokens.

    ``row`` is a struct of ``columns`` (all columns by default), so their names
    clash with nothing. ``scored``: held_out (``learned_not``), n_tokens,
    n_known, train_tokens, base_score (by the words' counts alone, one added),
    score (the model's), n_bytes, bits_per_byte (all bits over all bytes; over
    1 for an empty text).

    * Null and empty texts, and white space alone, are the end token.
    * Nothing is learned from rows where ``learned_not`` holds.
    * Repeated rows are documents of their own: each is learned from and scored.
    * Texts of any length are read whole; a word may be as long as its text.
    * White space counts as one space after each word, whatever it is.
    * Without anything to learn from, bits are even and only what a document
      repeats is foreseen. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    names = docs.columns if columns is None else columns
    rows = docs.select(
        F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"),
        learned_not.alias("held_out"),
        whole(text).alias("text"),
    )
    row = rows.schema["row"].dataType
    slices = keep(rows.mapInArrow(_slices, _slice_type(row)), "word-slices")
    seen = slices.select("slice", F.posexplode("words").alias("pos", "w")).select("slice", "pos", "w.*")
    # In order, words lie next to those they share their first bytes with.
    words = keep(seen.groupBy("word").agg(F.sum("n").alias("c")).sortWithinPartitions("word"), "words")
    known = words.filter("c > 0")
    total, distinct = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = (
        known.mapInArrow(count_bits, "block int, counts binary")
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(add_blocks, "block int, counts binary")
    )
    counts = np.zeros(2 * _offsets()[-1], np.int64)
    step = 2 << BLOCK_BITS
    # As many bytes as the tables have, whatever the corpus; a part at a time.
    for r in keep(blocks, "bit-counts").coalesce(8).toLocalIterator():
        counts[r.block * step : r.block * step + len(r.counts) // 8] = np.frombuffer(r.counts, np.int64)
    model = learn_from(counts.reshape(-1, 2), known.select("word"))
    shared = spark.sparkContext.broadcast(model)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = shared.value.word_logs(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_pydict(
                {"word": batch.column("word"), "c": batch.column("c"), "coded": pa.array(logs)}
            )

    coded = keep(words.mapInArrow(code, "word binary, c long, coded double"), "coded-words")
    own = (
        seen.select("slice", "pos", "word")
        .join(coded, "word")
        .groupBy("slice")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "c", "coded"))).alias("known"))
    )
    result = T.StructType([T.StructField("row", row), T.StructField("scored", SCORED)])
    return slices.drop("words").join(own, "slice").mapInArrow(lambda b: _score(b, total, distinct), result)
