"""Number parsing and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: shown where a number is missing.
NO_NUMBER = "–"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip_text(text: Column) -> Column:
    """Drop white space of every kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def parse_local_number(text: Column, kind: str = "double") -> Column:
    """``123.456,78`` as a number; blank or malformed text is NULL."""
    plain = F.replace(
        F.replace(strip_text(text), F.lit("."), F.lit("")), F.lit(","), F.lit(".")
    )
    return F.when(plain.rlike(_NUMBER), plain.try_cast(kind))


def format_amount(value: Column) -> Column:
    """Whole number with dots between thousands."""
    shown = F.translate(F.format_number(value.cast("double"), 0), ",", ".")
    return F.coalesce(shown, F.lit(NO_NUMBER))


def format_pct(value: Column) -> Column:
    """Signed percentage with one decimal.

    ``format_number`` rounds the binary value half to even; ``format_string``
    would round its shortest decimal form half up and differ on ties.
    """
    digits = F.replace(F.format_number(value.cast("double"), 1), F.lit(","), F.lit(""))
    signed = F.when(digits.startswith("-"), digits).otherwise(F.concat(F.lit("+"), digits))
    return F.coalesce(F.concat(signed, F.lit("%")), F.lit(NO_NUMBER))
