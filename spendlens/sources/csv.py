"""Yearly CSV files of a city ledger: semicolons and local numbers."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_local_number, strip_text
from ..spec import CITY, LedgerSpec
from .landed import Landed

# Spellings of the year column.
YEAR_NAMES = ("ar", "ár", "year", "year_of_record")


def normalize_column_name(name: str, spec: LedgerSpec = CITY) -> str:
    """Trimmed, lower-case, canonical name of a CSV column."""
    name = name.strip().lower()
    return spec.year if name in YEAR_NAMES else spec.canonical(name)


def year_in(path: str) -> int | None:
    """Year in the last part of a path."""
    found = re.search(r"(19|20)\d{2}", path.rstrip("/").rsplit("/", 1)[-1])
    return int(found.group(0)) if found else None


def merge_columns(df: DataFrame, spec: LedgerSpec = CITY) -> DataFrame:
    """Rename every column; when two become one, the first value counts."""
    raw = [f"_{i}" for i in range(len(df.columns))]
    grouped: dict[str, list[Column]] = {}
    for position, name in zip(raw, df.columns, strict=True):
        grouped.setdefault(normalize_column_name(name, spec), []).append(F.col(position))
    return df.toDF(*raw).select(
        *((F.coalesce(*cols) if len(cols) > 1 else cols[0]).alias(name)
          for name, cols in grouped.items())
    )


def _amount(text: Column) -> Column:
    return parse_local_number(text, "decimal(18,2)")


def open_years(spark: SparkSession, paths: list[str], spec: LedgerSpec = CITY) -> Landed:
    return Landed(
        spark, paths, ";", spec, lambda name: normalize_column_name(name, spec), YEAR_NAMES
    )


def year_problems(spark: SparkSession, paths: list[str], spec: LedgerSpec = CITY) -> DataFrame:
    """One row that counts what ``combine_years`` cannot use; see ``Landed.problems``."""
    return open_years(spark, paths, spec).problems(_amount)


def _year_of_path(file: Column, paths: list[str]) -> Column:
    """Year in the last part of the given path that a file lies under."""
    year = F.lit(None).cast("int")
    for path in sorted(paths, key=len):  # the longest path comes last, and first in the expression
        own = path.rstrip("/")
        under = F.contains(file, F.lit(own)) | F.contains(file, F.lit(quote(own, safe="/:=")))
        year = F.when(under, F.lit(year_in(own)).cast("int")).otherwise(year)
    return year


def combine_years(spark: SparkSession, paths: Iterable[str], spec: LedgerSpec = CITY) -> DataFrame:
    """Yearly CSVs (files, or folders of parts) as typed ledger lines, in one scan.

    Everything is read as text, so types cannot drift between years. The
    amount is parsed in local format, the year falls back to the one in the
    name, lines are no corrections unless the file says so, and a column a
    year lacks is NULL there.
    """
    paths = list(paths)
    if not paths:
        raise ValueError("no CSV files to combine")
    df = open_years(spark, paths, spec).lines()
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in spec.schema.fields}
    if spec.amount in df.columns:
        typed[spec.amount] = _amount(F.col(spec.amount))
    fallback = _year_of_path(F.col("_file"), paths)
    typed[spec.year] = (
        F.coalesce(parse_local_number(F.col(spec.year)).cast("int"), fallback)
        if spec.year in df.columns
        else fallback
    )
    typed[spec.flag] = (
        F.coalesce(F.lower(strip_text(F.col(spec.flag))).try_cast("boolean"), F.lit(False))
        if spec.flag in df.columns
        else F.lit(False)
    )
    names = [c for c in df.columns if c != "_file"]
    names += [c for c in (spec.year, spec.flag) if c not in names]
    return df.select(*(typed.get(c, F.col(f"`{c}`")).alias(c) for c in names))


def ingest_year_file(spark: SparkSession, path: str, spec: LedgerSpec = CITY) -> DataFrame:
    return combine_years(spark, [path], spec)
