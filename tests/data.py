"""Small hand-made ledgers."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from spendlens.sources import conform, with_year
from spendlens.spec import CITY, STATE

STATE_FIELDS = ("buyer", "seller", "type", "amount", "paid_on", "invoice", "is_correction")
CITY_FIELDS = tuple(CITY.schema.names)


def day(text: str | None) -> dt.date | None:
    return dt.date.fromisoformat(text) if text else None


def money(value) -> Decimal | None:
    return None if value is None else Decimal(str(value))


def state(spark, rows):
    """Rows of (buyer, seller, type, amount, day, invoice, flag)."""
    made = [(b, s, t, money(a), day(d), i, f) for b, s, t, a, d, i, f in rows]
    return with_year(spark.createDataFrame(made, STATE.schema), STATE)


def city(spark, rows):
    """Rows as dicts; what is not named is NULL."""
    made = [
        tuple(money(r.get(c)) if c == "amount" else r.get(c) for c in CITY_FIELDS) for r in rows
    ]
    return conform(spark.createDataFrame(made, CITY.schema), CITY)


def rows(df, *columns):
    if columns:
        df = df.select(*columns)
    return sorted((tuple(r) for r in df.collect()), key=repr)
