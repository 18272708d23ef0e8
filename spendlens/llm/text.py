"""Column expressions on texts shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: Column | str) -> Column:
    """The text; empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column | str) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def unit(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the values alone, so reruns agree."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns), 12)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def letter_share(text: Column | str) -> Column:
    """Letters among the characters that are not white space; 0 without any."""
    body = whole(text)
    letters = F.length(F.regexp_replace(body, r"[^\p{L}]++", ""))
    return F.coalesce(letters / F.nullif(F.length(F.regexp_replace(body, r"\s++", "")), F.lit(0)), F.lit(0.0))
