from __future__ import annotations

import datetime as dt
from collections import Counter
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spendlens.operators import corrections as C
from spendlens.spec import CITY, STATE

from .data import city, state

FIRST = dt.date(2020, 1, 1)


def hit_invoices(lines, threshold, tolerance, symmetric=False):
    """All pairs, as the definition says."""
    hit = set()
    for a in lines:
        for b in lines:
            if None in a[:3] or a[:3] != b[:3] or not a[4] or not b[4]:
                continue
            x, y = Decimal(str(a[3])), Decimal(str(b[3]))
            gap = (dt.date.fromisoformat(b[4]) - dt.date.fromisoformat(a[4])).days
            if 0 <= gap <= 2 and (x > 0) != (y > 0) and abs(x) > threshold and abs(abs(x) - abs(y)) < tolerance:
                hit.add(a[5])
                if symmetric:
                    hit.add(b[5])
    return hit - {None}


BIG = 5000


@pytest.mark.parametrize(
    ("second", "day", "hit"),
    [
        (-5000.01, "2020-01-01", {"1", "2"}), (-5500, "2020-01-03", {"1"}), (-5500, "2020-01-04", set()),
        (-6001.00, "2020-01-01", {"1", "2"}), (-6001.01, "2020-01-01", set()), (5001.01, "2020-01-01", set()),
        (-4001.02, "2020-01-01", {"1"}), (-4001.01, "2020-01-01", set()), (-5500, None, set()),
    ],
)
def test_one_pair(spark, second, day, hit):
    lines = [
        ("A", "s", "t", 5001.01, "2020-01-01", "1", None), ("A", "s", "t", second, day, "2", None),
    ]
    got = C.corrected_invoices(state(spark, lines), STATE, threshold=BIG, tolerance=1000)
    assert {r[0] for r in got.collect()} == hit == hit_invoices(lines, BIG, 1000)


LINE = st.tuples(
    st.sampled_from(["A", "B", None]), st.just("s"), st.sampled_from(["t", "u"]),
    st.sampled_from([-1, 1]).flatmap(lambda s: st.integers(0, 3000).map(lambda c: s * c / 100)),
    st.one_of(st.none(), st.integers(0, 5).map(lambda d: (FIRST + dt.timedelta(d)).isoformat())),
    st.one_of(st.none(), st.integers(0, 30).map(str)), st.none(),
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(LINE, min_size=25, max_size=120), st.sampled_from([0, 5, 12]), st.sampled_from([0.5, 3, 10]),
       st.booleans())
def test_any_ledger_matches_all_pairs(spark, lines, threshold, tolerance, symmetric):
    got = C.corrected_invoices(
        state(spark, lines), STATE, threshold=threshold, tolerance=tolerance, symmetric=symmetric
    )
    assert {r[0] for r in got.collect()} == hit_invoices(
        lines, Decimal(threshold), Decimal(str(tolerance)), symmetric
    )


def test_all_lines_of_a_hit_invoice_are_marked(spark):
    df = state(spark, [
        ("A", "s", "t", 9000, "2020-01-01", "1", None), ("A", "s", "t", 3, "2019-01-01", "1", True),
        ("A", "s", "t", -9000, "2020-01-02", "2", None), ("A", "s", "t", 3, "2019-01-01", None, True),
    ])
    flagged = C.flag_state_corrections(df, STATE, threshold=BIG, tolerance=1000)
    assert Counter((r["invoice"], r["is_correction"]) for r in flagged.collect()) == {
        ("1", True): 2, ("2", False): 1, (None, False): 1,
    }
    both = C.flag_state_corrections(df, STATE, threshold=BIG, tolerance=1000, symmetric=True)
    assert {r["invoice"] for r in both.collect() if r["is_correction"]} == {"1", "2"}


CITY_LINE = st.fixed_dictionaries({
    "year": st.sampled_from([2020, 2021, None]), "org0": st.sampled_from(["o", None]),
    "type4": st.sampled_from(["x", None]), "company": st.sampled_from(["c", "d"]),
    "amount": st.one_of(st.none(), st.integers(-3000, 3000).map(lambda c: c / 100)),
})


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(CITY_LINE, min_size=20, max_size=100), st.sampled_from([0, 5, 12]), st.sampled_from([0.5, 3, 10]))
def test_city_lines_match_all_pairs(spark, lines, threshold, tolerance):
    keys = ("year", "org0", "type4", "company")
    numbered = [{**r, "vat_name": str(i)} for i, r in enumerate(lines)]
    wanted = set()
    for a in numbered:
        for b in numbered:
            if a["year"] is None or any(a[k] != b[k] for k in keys) or None in (a["amount"], b["amount"]):
                continue
            x, y = Decimal(str(a["amount"])), Decimal(str(b["amount"]))
            if x * y < 0 and abs(x) > threshold and abs(abs(x) - abs(y)) < Decimal(str(tolerance)):
                wanted.add(a["vat_name"])
    df = city(spark, numbered)
    flagged = C.flag_city_corrections(df, CITY, threshold=threshold, tolerance=tolerance).collect()
    assert len(flagged) == len(lines)
    assert {r["vat_name"] for r in flagged if r["is_correction"]} == wanted
    found = C.corrected_lines(df, CITY, threshold=threshold, tolerance=tolerance)
    assert found.columns == df.columns
    assert {r["vat_name"] for r in found.collect()} == wanted


def test_a_crowded_key_needs_no_pairs(spark):
    """20,000 opposite lines of one key on one day: 10^8 pairs if built."""
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(
        F.lit("A").alias("buyer"), F.lit("s").alias("seller"), F.lit("t").alias("type"),
        (F.when(F.col("id") % 2 == 0, 9000).otherwise(-9000) + F.col("id") % 10).cast("decimal(18,2)").alias("amount"),
        F.lit("2020-01-01").cast("date").alias("paid_on"), F.col("id").cast("string").alias("invoice"),
        F.lit(False).alias("is_correction"),
    )
    cells = C.matched_cells(
        C.with_cell(df, STATE, 1000), ["buyer", "seller", "type"], "paid_on", [0, -1, -2],
        F.lit(True), F.lit(True), 1000,
    )
    assert cells.count() <= 4
    assert C.flag_state_corrections(df, STATE, threshold=BIG, tolerance=1000).filter("is_correction").count() == 20_000


def test_lines_of_one_invoice_are_dealt_over_parts(spark):
    """A placeholder invoice on most lines, and lines without any."""
    from pyspark.sql import functions as F

    df = spark.range(3000).select(
        F.lit("A").alias("buyer"), F.lit("s").alias("seller"), F.lit("t").alias("type"),
        F.col("id").cast("decimal(18,2)").alias("amount"), F.lit("2020-01-01").cast("date").alias("paid_on"),
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") < 2900, "0").otherwise(F.col("id").cast("string")).alias("invoice"),
        F.lit(True).alias("is_correction"),
    )
    hits = spark.createDataFrame([("0",), ("2998",)], "invoice string")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = C.flag_by_invoice(df, STATE, hits)
        plan = marked._jdf.queryExecution().executedPlan().toString()
        got = {(r.invoice, r.is_correction): r["count"] for r in marked.groupBy("invoice", "is_correction").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert "_salt" in plan
    assert "_part" in plan
    assert got[None, False] == 1000
    assert got["0", True] == sum(1 for i in range(2900) if i % 3)
    assert got["2998", True] == 1
    assert sum(got.values()) == 3000
    assert not any(flag for (i, flag) in got if i not in ("0", "2998"))
