"""Predicates. Every function returns a Column (or a frame of options)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import LedgerSpec

ALL = "all"


def is_set(value: object) -> bool:
    """Whether a filter value restricts anything."""
    return bool(value) and value != ALL


def match_all(conditions: Iterable[tuple[str | Column, object]]) -> Column:
    """Conjunction of equalities; empty values and ``all`` are skipped."""
    parts = [
        (F.col(c) if isinstance(c, str) else c) == F.lit(v)
        for c, v in conditions
        if is_set(v)
    ]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def keep_lines(spec: LedgerSpec, show_corrections: bool = False) -> Column:
    """Lines not marked as corrections; an unknown mark keeps the line."""
    if show_corrections:
        return F.lit(True)
    return ~F.coalesce(F.col(spec.flag), F.lit(False))


def year_number(year: object) -> int:
    """A year argument as a number; ``2024*`` is 2024, junk matches nothing (0)."""
    text = str(year).rstrip("*")
    return int(text) if text.isdigit() else 0


def year_is(spec: LedgerSpec, year: object) -> Column:
    """One year, or everything for ``all``.

    A ledger with a payment date also gets the date range: a function of a
    column never reaches the Parquet scan, a range on the column does.
    """
    if not is_set(year):
        return F.lit(True)
    number = year_number(year)
    same_year = F.col(spec.year) == number
    if spec.date and 1 <= number < 9999:
        day = F.col(spec.date)
        first = F.lit(f"{number:04d}-01-01").cast("date")
        after = F.lit(f"{number + 1:04d}-01-01").cast("date")
        return (day >= first) & (day < after) & same_year
    return same_year


def year_in(spec: LedgerSpec, wanted: Iterable[int]) -> Column:
    """Any of several years."""
    return reduce(lambda a, b: a | b, (year_is(spec, y) for y in wanted), F.lit(False))


def sign_is(spec: LedgerSpec, sign: str) -> Column:
    amount = F.col(spec.amount)
    return {"pos": amount > 0, "neg": amount < 0}.get(sign, F.lit(True))


def seller_is(spec: LedgerSpec, seller: object) -> Column:
    return spec.seller == F.lit(seller) if is_set(seller) else F.lit(True)


@dataclass(frozen=True)
class Selection:
    """The filters of an explorer view."""

    year: object = ALL
    type: str | None = ALL
    buyer: str | None = ALL
    unit: str | None = ALL
    seller: str | None = ALL
    sign: str = ALL
    show_corrections: bool = False

    def predicate(self, spec: LedgerSpec, with_year: bool = True) -> Column:
        equal = [(spec.type, self.type), (spec.buyer, self.buyer)]
        if is_set(self.unit):
            equal.append((spec.buyers[1], self.unit))
        condition = (
            match_all(equal)
            & seller_is(spec, self.seller)
            & sign_is(spec, self.sign)
            & keep_lines(spec, self.show_corrections)
        )
        return condition & year_is(spec, self.year) if with_year else condition


@dataclass(frozen=True)
class AnomalySelection:
    """The filters of an anomaly view."""

    year: object = ALL
    direction: str = ALL
    min_change_pct: object = None

    def threshold(self) -> float | None:
        """The minimum as a number; text that is none is no filter."""
        if self.min_change_pct in (None, ""):
            return None
        try:
            return float(self.min_change_pct)
        except (TypeError, ValueError):
            return None

    def predicate(self, with_year: bool = True) -> Column:
        """A NULL percentage never passes a direction or a minimum."""
        pct = F.col("yoy_real_pct")
        condition = F.lit(True)
        if with_year and is_set(self.year):
            condition &= F.col("year") == year_number(self.year)
        if self.direction == "up":
            condition &= pct > 0
        elif self.direction == "down":
            condition &= pct < 0
        floor = self.threshold()
        if floor is not None:
            condition &= F.abs(pct) >= F.lit(floor)
        return condition


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-NULL values of a column, sorted."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def years(df: DataFrame, spec: LedgerSpec) -> DataFrame:
    """Distinct years, newest first."""
    year = F.col(spec.year)
    return df.select(year).filter(year.isNotNull()).distinct().orderBy(year.desc())


def search_options(df: DataFrame, column: str, text: str) -> DataFrame:
    """Options that contain the text, ignoring case and outer blanks."""
    found = options(df, column)
    wanted = text.strip().lower()
    return found.filter(F.lower(column).contains(wanted)) if wanted else found


def valid_or_all(df: DataFrame, column: str, value: object) -> object:
    """The value when it occurs in the column, else ``all``.

    Stops at the first matching line; nothing but a yes or no reaches the
    driver.
    """
    if not is_set(value):
        return ALL
    return ALL if df.filter(F.col(column) == F.lit(value)).select(column).isEmpty() else value
