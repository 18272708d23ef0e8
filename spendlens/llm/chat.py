"""Conversations as training text, assembled column by column.

A turn becomes ``<s>role[INST]text[/INST]</s>`` and a line break. Control strings
inside roles and texts get a ``^`` after their first character (one more if
they have some already), which reading back takes out again.

Turns arrive ordered by conversation. For each batch the lengths of all
segments give their offsets by one running sum, and constants and values are
copied through index arrays into one buffer that becomes the Arrow column. A
batch is cut at ``BLOCK`` bytes, and only a few numbers are carried from batch
to batch, so neither a long conversation nor a long text needs more.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = b"<s>", b"[INST]", b"[/INST]</s>\n"
#: Patterns of control strings, with the replacement that escapes them and back.
ESCAPES = ((r"\[(\^*/?INST\])", r"[^\1", r"\[\^(\^*/?INST\])", r"[\1"), (r"<(\^*/?s>)", r"<^\1", r"<\^(\^*/?s>)", r"<\1"))
TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>\n", re.DOTALL)
LEARNT = "assistant"
#: Bytes of a block; texts longer than LONG are copied as they are, not by index.
BLOCK = 8 << 20
LONG = 1 << 16


def escape(values: pa.Array) -> pa.Array:
    for pattern, safe, _, _ in ESCAPES:
        values = pc.replace_substring_regex(values, pattern, safe)
    return values


def unescape(value: str) -> str:
    for _, _, pattern, plain in ESCAPES:
        value = re.sub(pattern, plain, value)
    return value


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and data of a string column without nulls."""
    column = pa.concat_arrays([column.cast(pa.large_string())])
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8)


def assemble(roles: pa.Array, texts: pa.Array) -> pa.Array:
    """One formatted string per turn, in a single buffer. Inputs are escaped, without nulls."""
    n = len(roles)
    values = [_bytes(roles), _bytes(texts)]
    lengths = np.empty((n, 5), dtype=np.int64)
    lengths[:, 0::2] = [len(OPEN), len(MIDDLE), len(CLOSE)]
    for k, (at, _) in zip((1, 3), values):
        lengths[:, k] = np.diff(at)
    ends = lengths.ravel().cumsum()
    starts = (ends - lengths.ravel()).reshape(n, 5)
    out = np.empty(ends[-1] if n else 0, dtype=np.uint8)
    for k, constant in zip((0, 2, 4), (OPEN, MIDDLE, CLOSE)):
        out[starts[:, k, None] + np.arange(len(constant))] = np.frombuffer(constant, np.uint8)
    for k, (at, data) in zip((1, 3), values):
        size = lengths[:, k]
        for i in np.flatnonzero(size > LONG):
            out[starts[i, k] : starts[i, k] + size[i]] = data[at[i] : at[i + 1]]
        short = np.flatnonzero(size <= LONG)
        count = size[short]
        within = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count)
        out[np.repeat(starts[short, k], count) + within] = data[np.repeat(at[short], count) + within]
    offsets = np.concatenate([[0], ends[4::5]]).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out))


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about BLOCK bytes, one row at least."""
    size = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
    block = size.cumsum() // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _first_rows(ids: pa.Array, last: list) -> np.ndarray:
    """Where a conversation starts; ``last`` holds the id of the row before, if any."""
    before = pa.concat_arrays([pa.array(last[:1] or [None], ids.type), ids[:-1]])
    same = pc.fill_null(pc.equal(before, ids), False).to_numpy(zero_copy_only=False)
    nulls = pc.and_(before.is_null(), ids.is_null()).to_numpy(zero_copy_only=False)
    first = ~(same | nulls)
    if not last:
        first[0] = True
    return first


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: list = []
    turn, chars = -1, 0
    for batch in batches:
        for part in _blocks(batch):
            ids, role = part.column("conv"), part.column("role")
            safe_role, safe_text = escape(role), escape(part.column("text"))
            text = assemble(safe_role, safe_text)
            size = pc.utf8_length(text).to_numpy().astype(np.int64)
            first = _first_rows(ids, last)
            # Running sums that start anew with each conversation.
            group = first.cumsum()
            start = size.cumsum() - size
            at = np.flatnonzero(first)
            base = np.concatenate([[-chars], start[at]])
            nth = np.concatenate([[-turn - 1], at])
            start = start - base[group]
            number = np.arange(len(size)) - nth[group]
            head = len(OPEN) + len(MIDDLE) + pc.utf8_length(safe_role).to_numpy().astype(np.int64)
            learnt = pc.equal(role, LEARNT)
            none = pa.scalar(None, pa.int64())
            inner = start + head
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(number),
                    text,
                    pa.array(start),
                    pc.if_else(learnt, pa.array(inner), none),
                    pc.if_else(learnt, pa.array(inner + pc.utf8_length(safe_text).to_numpy()), none),
                ],
                names=["conv_id", "nth", "formatted", "char_start", "loss_start", "loss_end"],
            )
            last, turn, chars = [ids[-1].as_py()], int(number[-1]), int(start[-1] + size[-1])


def format_turns(conversations: DataFrame) -> DataFrame:
    """A row per turn: (conv_id, nth, formatted, char_start, loss_start, loss_end).

    A conversation's text is its ``formatted`` joined by ``nth`` (from 0).
    ``char_start`` is where the turn starts in it, and the loss covers
    ``loss_start`` to ``loss_end`` (code points, end exclusive) in turns of the
    assistant; both are null in others.

    * Order: turn, then role, then text; nulls first. Repeated rows repeat.
    * Null role or text: empty. Null conv_id: one conversation of its own.
    * Extra columns are dropped; an empty table gives an empty table.

    Turns of a conversation meet in one task, as a stream.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turns = conversations.select(
        F.col("conv_id").alias("conv"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return (
        turns.repartition("conv")
        .sortWithinPartitions("conv", "turn", "role", "text")
        .select("conv", "role", "text")
        .mapInArrow(
            _format,
            f"conv_id {kind}, nth long, formatted string, char_start long, loss_start long, loss_end long",
        )
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    last: list = []
    state: list = []

    def result() -> list:
        turns, n, loss, learnt, chars = state
        return [last[0], n, turns.hexdigest(), learnt, loss.hexdigest(), chars]

    for batch in batches:
        first = _first_rows(batch.column("conv_id"), last) if batch.num_rows else []
        done = []
        columns = [batch.column(c) for c in ("conv_id", "formatted", "char_start", "loss_start", "loss_end")]
        for i, new in enumerate(first):
            conv, text, at, a, b = (c[i].as_py() for c in columns)
            if new:
                if state:
                    done.append(result())
                state = [hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for m in TURN.finditer(text):
                state[0].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                state[1] += 1
            if a is not None:
                learnt = unescape(text[a - at : b - at])
                state[2].update(learnt.encode())
                state[3] += len(learnt)
            state[4] = at + len(text)
            last = [conv]
        if done:
            yield _rows(done, names, batch.schema.field("conv_id").type)
    if state:
        yield _rows([result()], names, None)


def _rows(rows: list[list], names: list[str], kind: pa.DataType | None) -> pa.RecordBatch:
    kinds = [kind or pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, k) for v, k in zip(map(list, zip(*rows)), kinds)], names=names
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation of the turns that ``format_turns`` has written.

    Turns are parsed out of the text and unescaped; what is learnt is cut out
    by the loss span. Hashes run over a conversation as a stream, in the order
    in which ``format_turns`` returns it.
    """
    return formatted.mapInArrow(
        _read,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
