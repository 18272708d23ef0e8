from __future__ import annotations

import re

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendlens.operators import anomalies, changes, comparison, drilldown, enrich, preview, totals, yoy
from spendlens.operators.filters import (
    AnomalySelection,
    Selection,
    keep_lines,
    match_all,
    options,
    search_options,
    sign_is,
    valid_or_all,
    year_is,
    year_number,
    years,
)
from spendlens.spec import CITY, STATE

from .data import city, rows, state


@pytest.fixture(scope="module")
def lines(spark):
    return state(spark, [
        ("A", "s1", "t1", 100, "2020-03-01", "1", False),
        ("A", "s1", "t1", -40, "2020-03-02", "2", None),
        ("A", "s2", "t2", 999, "2020-03-02", "3", True),
        ("B", "s1", "t1", 70, "2021-05-01", "4", None),
        (None, "s2", "t1", 5, "2021-05-01", "5", False),
        ("A", "s1", "t1", 10, "2023-12-31", "6", False),
        ("B", None, "t2", 1, None, "7", False),
    ]).cache()


def test_unknown_mark_keeps_the_line(lines):
    assert lines.filter(keep_lines(STATE)).count() == 6
    assert lines.filter(keep_lines(STATE, show_corrections=True)).count() == 7


def test_empty_conditions_are_skipped(lines):
    assert lines.filter(match_all([("buyer", "all"), ("type", ""), ("seller", None)])).count() == 7
    assert lines.filter(match_all([("buyer", "A"), ("type", "t1")])).count() == 3


@pytest.mark.parametrize(
    ("year", "number"), [("2024*", 2024), ("2024", 2024), (2024, 2024), ("20x4", 0), ("-5", 0)]
)
def test_year_number(year, number):
    assert year_number(year) == number


def test_year_filter(lines):
    assert lines.filter(year_is(STATE, "2020*")).count() == 3
    assert lines.filter(year_is(STATE, "junk")).count() == 0
    assert lines.filter(year_is(STATE, "all")).count() == 7


def test_sign(lines):
    assert [lines.filter(sign_is(STATE, s)).count() for s in ("pos", "neg", "all")] == [6, 1, 7]


def test_headline(lines):
    got = rows(totals.headline_yearly(lines, STATE))
    assert got == [
        (2020, "2020", Decimal("100.00"), Decimal("-40.00"), Decimal("60.00")),
        (2021, "2021", Decimal("75.00"), Decimal("0.00"), Decimal("75.00")),
        (2023, "2023*", Decimal("10.00"), Decimal("0.00"), Decimal("10.00")),
    ]
    assert rows(totals.headline_latest(lines, STATE)) == [(2023, Decimal("10.00"))]
    nothing = lines.filter("false")
    assert rows(totals.headline_latest(nothing, STATE)) == []


def test_totals_of_nothing_are_one_row(lines):
    none = Selection(type="nope").predicate(STATE)
    assert rows(totals.overall(lines, STATE, none)) == [(0, None, None, None)]
    assert rows(totals.page_count(lines, none, 50)) == [(0, 1)]
    assert rows(totals.page_count(lines, F.lit(True), 3)) == [(7, 3)]


def test_breakdown_sums_up_to_the_total(lines):
    where = Selection().predicate(STATE)
    parts = rows(totals.breakdown(lines, STATE, "buyer", where))
    assert ("A", Decimal("70.00"), 3) in parts
    assert (None, Decimal("5.00"), 1) in parts
    assert sum(p[1] for p in parts) == totals.overall(lines, STATE, where).first()["total"]


def test_label_of_a_missing_group_stays_apart_from_a_group_of_that_name(spark):
    df = city(spark, [
        {"type0": None, "amount": 1}, {"type0": "Ótilgreint", "amount": 5}, {"type0": "x", "amount": 3},
    ])
    got = totals.breakdown(df, CITY, "type0", F.lit(True), missing=CITY.type_fallback)
    assert [tuple(r) for r in got.collect()] == [
        ("Ótilgreint", Decimal("5.00"), 1), ("x", Decimal("3.00"), 1), ("Ótilgreint", Decimal("1.00"), 1),
    ]


def test_top_groups_rank_by_size_not_sign(lines):
    got = totals.top_groups(lines, STATE, "type", F.col("amount") < 0, top=5)
    assert [tuple(r) for r in got.collect()] == [("t1", Decimal("-40.00"), 1, None, Decimal("-40.00"))]


def test_options_and_search(lines):
    assert [r[0] for r in options(lines, "buyer").collect()] == ["A", "B"]
    assert [r[0] for r in years(lines, STATE).collect()] == [2023, 2021, 2020]
    assert [r[0] for r in search_options(lines, "seller", " S2 ").collect()] == ["s2"]
    assert search_options(lines, "seller", "  ").count() == 2
    assert valid_or_all(lines, "buyer", "A") == "A"
    assert valid_or_all(lines, "buyer", "Z") == "all"
    assert valid_or_all(lines, "buyer", "") == "all"


def test_two_year_change_needs_both_years(spark):
    df = state(spark, [
        ("A", "s", "t", 10, "2020-01-01", "1", False), ("A", "s", "t", 25, "2021-01-01", "2", True),
        ("B", "s", "t", 10, "2021-01-01", "3", False), (None, "s", "t", 1, "2020-01-01", "4", False),
        (None, "s", "t", 1, "2021-01-01", "5", False), ("C", "s", "t", 0, "2020-01-01", "6", False),
        ("C", "s", "t", 3, "2021-01-01", "7", False), ("D", "s", "t", 9, "2015-01-01", "8", False),
    ])
    got = comparison.two_year_change(df, STATE, "buyer")
    assert [tuple(r) for r in got.collect()] == [
        ("A", Decimal("25.00"), Decimal("10.00"), Decimal("15.00"), 150.0, "up", 2020, 2021),
        ("C", Decimal("3.00"), Decimal("0.00"), Decimal("3.00"), None, "up", 2020, 2021),
    ]
    one_year = df.filter("year = 2021")
    assert comparison.two_year_change(one_year, STATE, "buyer").count() == 0


def test_selected_change_skips_gaps(lines):
    got = rows(changes.selected_change(lines, STATE, match_all([("buyer", "A")]) & keep_lines(STATE)))
    assert got == [(2020, Decimal("60.00"), None), (2023, Decimal("10.00"), pytest.approx(-83.3333333))]


def test_average_change_per_year(spark):
    df = state(spark, [
        ("A", "s", "t", 10, "2020-01-01", "1", None), ("A", "s", "t", 20, "2021-01-01", "1", None),
        ("B", "s", "t", 10, "2020-01-01", "1", None), ("B", "s", "t", 15, "2021-01-01", "1", None),
        ("C", "s", "t", 10, "2021-01-01", "1", None), (None, "s", "t", 1, "2020-01-01", "1", None),
        (None, "s", "t", 9, "2021-01-01", "1", None),
    ])
    assert rows(changes.average_change(df, STATE, "buyer")) == [(2021, 75.0)]
    got = rows(changes.change_against_average(df, STATE, "buyer", match_all([("buyer", "A")])))
    assert got == [
        (2020, Decimal("10.00"), None, None, None), (2021, Decimal("20.00"), 100.0, 75.0, 25.0),
    ]


def yoy_by_join(df, keys):
    """The definition: a null-safe left join on the year before."""
    yearly = df.filter(keep_lines(STATE) & F.col("year").isNotNull()).groupBy("year", *keys).agg(
        F.sum("amount").alias("a")
    )
    prior = yearly.select((F.col("year") + 1).alias("py"), *(F.col(k).alias(f"p_{k}") for k in keys), F.col("a").alias("p"))
    cond = F.col("year") == F.col("py")
    for k in keys:
        cond &= F.col(k).eqNullSafe(F.col(f"p_{k}"))
    return yearly.join(prior, cond, "left").select("year", *keys, "a", F.coalesce("p", F.lit(0)).alias("p"))


def test_yoy_equals_the_self_join(spark, small):
    from spendlens.sources.star import state_ledger

    df = state_ledger(spark, small).withColumn("seller", F.nullif("seller", F.lit("NATION_3")))
    got = yoy.year_over_year(df, STATE).select("year", *STATE.grain, "actual_real", "prior_real")
    assert rows(got) == rows(yoy_by_join(df, STATE.grain))


def test_yoy_cases(spark):
    df = state(spark, [
        ("A", None, "t", 10, "2020-01-01", "1", None), ("A", None, "t", 30, "2021-01-01", "1", None),
        ("A", None, "t", 5, "2023-01-01", "1", None), ("B", "s", "t", 10, "2020-01-01", "1", None),
        ("B", "s", "t", -10, "2020-01-01", "1", None), ("B", "s", "t", 4, "2021-01-01", "1", None),
        ("C", "s", "t", 7, "2020-01-01", "1", None), ("C", "s", "t", 7, None, "1", None),
        ("A", None, "t", 1000, "2021-01-01", "1", True),
    ])
    got = {(r["buyer"], r["year"]): (r["prior_real"], r["yoy_real_change"], r["yoy_real_pct"])
           for r in yoy.year_over_year(df, STATE).collect()}
    assert got == {
        ("A", 2020): (0, 10, None), ("A", 2021): (10, 20, 200.0), ("A", 2023): (0, 5, None),
        ("B", 2020): (0, 0, None), ("B", 2021): (0, 4, None), ("C", 2020): (0, 7, None),
    }
    table = yoy.year_over_year(df, STATE)
    assert yoy.flag_anomalies(table, 20, 7).count() == 3
    assert yoy.flag_anomalies(table, 20, 1000).count() == 1


def test_yoy_of_some_years_is_part_of_the_whole(spark, small):
    from spendlens.sources.star import city_ledger, state_ledger

    for spec, build in ((STATE, state_ledger), (CITY, city_ledger)):
        df = build(spark, small)
        whole = yoy.year_over_year(df, spec).filter("year IN (1996, 1999)")
        assert rows(yoy.year_over_year(df, spec, [1999, 1996])) == rows(whole)


@pytest.fixture(scope="module")
def table(spark):
    make = "g string, type string, buyer string, year int, actual_real decimal(28,2), prior_real decimal(28,2), yoy_real_change decimal(28,2), yoy_real_pct double"
    data = [
        ("x", "t1", "A", 2020, 30, 10, 20, 200.0), ("x", "t1", "A", 2021, 10, 30, -20, -66.7),
        ("x", "t1", "B", 2020, 5, 0, 5, None), ("x", "t2", "A", 2020, 8, 10, -2, -20.0),
        ("x", "t1", None, 2020, 99, 1, 98, 9800.0),
    ]
    rows_ = [(g, t, b, y, Decimal(a), Decimal(p), Decimal(c), q) for g, t, b, y, a, p, c, q in data]
    return spark.createDataFrame(rows_, make)


def test_score_sums_years_first(table):
    got = anomalies.anomaly_score(table, "buyer", F.lit(True), 5)
    assert [tuple(r) for r in got.collect()] == [
        ("A", 2, Decimal("38.00"), 90.0, 19.0), ("B", 1, Decimal("5.00"), None, 5.0),
    ]


def test_detail_recomputes_the_percentage(table):
    got = anomalies.anomaly_detail(table, "buyer", F.lit(True))
    assert [(r["grp"], r["period"], r["pct"], r["direction"]) for r in got.collect()] == [
        ("A", "2019 → 2020", 90.0, "up"), ("A", "2020 → 2021", pytest.approx(-66.6666667), "down"),
        ("B", "2019 → 2020", None, "up"),
    ]


def test_anomaly_filters(table):
    assert table.filter(AnomalySelection(direction="up").predicate()).count() == 2
    assert table.filter(AnomalySelection(direction="down").predicate()).count() == 2
    assert table.filter(AnomalySelection(min_change_pct="100").predicate()).count() == 2
    assert table.filter(AnomalySelection(min_change_pct="lots").predicate()).count() == 5
    assert table.filter(AnomalySelection(year="2021").predicate()).count() == 1


def test_context_counts_default_to_zero(lines, table):
    got = anomalies.anomaly_context(
        lines, table, STATE, ("type", "buyer"), "t1", AnomalySelection(direction="down").predicate(), within="B"
    )
    assert sorted((r["grp"], r["total_amount"], r["years_with_spend"], r["anomaly_years"], r["is_selected"])
                  for r in got.collect()) == [
        ("A", Decimal("70.00"), 2, 1, False), ("B", Decimal("70.00"), 1, 0, True),
    ]


def test_series_fills_missing_years(lines, table):
    got = anomalies.anomaly_year_series(lines, table, STATE, F.lit(True), [("buyer", "A"), ("type", "t1")])
    assert rows(got) == [
        (2020, Decimal("60.00"), None, True), (2021, Decimal("0.00"), -100.0, True), (2023, Decimal("10.00"), None, False),
    ]
    alone = anomalies.anomaly_year_series(None, table, STATE, F.lit(True))
    assert [r[0] for r in rows(alone)] == [2020, 2021]


def test_drilldown_of_a_city_seller_adapts(spark):
    df = city(spark, [
        {"vat_name": "v", "expense_code": "1", "expense_label": "one", "org0": "o", "amount": 5, "year": 2020},
        {"vat_name": "v", "expense_code": "2", "org0": "o", "amount": 9, "year": 2020},
        {"vat_name": "v", "org0": "o", "amount": 1, "year": 2020},
        {"company": "w", "org0": "o", "amount": 2, "year": 2020},
        {"company": "w", "amount": 3, "year": 2020},
    ])
    assert [tuple(r) for r in drilldown.drill_seller_adaptive(df, CITY, "v").collect()] == [
        ("2", Decimal("9.00"), 1), ("one", Decimal("5.00"), 1), ("(óskráð)", Decimal("1.00"), 1),
    ]
    assert [tuple(r) for r in drilldown.drill_seller_adaptive(df, CITY, "w").collect()] == [
        ("(óskráð)", Decimal("3.00"), 1), ("o", Decimal("2.00"), 1),
    ]


def test_city_drilldown_leaves_out_lines_without_unit(spark):
    df = city(spark, [
        {"type0": "t", "org0": None, "amount": 1, "year": 2020}, {"type0": "t", "org0": "o", "amount": 2, "year": 2020},
    ])
    assert rows(drilldown.drill_type_buyers(df, CITY, "t")) == [("o", Decimal("2.00"), 1)]


def test_pages_cover_everything_once(spark, small, monkeypatch):
    from spendlens.sources.star import state_ledger

    df = state_ledger(spark, small, ["year", "buyer", "seller", "type", "amount", "paid_on", "is_correction"])
    whole = preview.preview_lines(df, STATE, STATE.preview).orderBy(*preview.page_order(STATE, STATE.preview)).collect()
    for at_once, boundaries in ((20_000, 31), (300, 5)):
        monkeypatch.setattr(preview, "AT_ONCE", at_once)
        monkeypatch.setattr(preview, "BOUNDARIES", boundaries)
        for page in (1, 3, 12):
            got = preview.preview_page(df, STATE, F.lit(True), page, 500).collect()
            assert got == whole[(page - 1) * 500: page * 500]
    # A page larger than the application's, inside one year.
    one = df.filter("year = 1997")
    same = [r for r in whole if r.year == 1997]
    assert preview.preview_page(one, STATE, F.lit(True), 2, 600).collect() == same[600:1200]
    assert preview.preview_page(df, STATE, F.lit(True), 100, 500).count() == 0
    assert preview.clamp_limit(0) == 1
    assert preview.clamp_limit(9999) == 500


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_far_pages_of_a_stored_ledger_read_their_days_alone(spark, small, tmp_path):
    from spendlens.sources.star import state_ledger

    path = str(tmp_path / "ledger")
    state_ledger(spark, small, ["year", "buyer", "seller", "type", "amount", "paid_on"]).write.parquet(path)
    df = spark.read.parquet(path)
    stored = str(tmp_path / "days")
    preview.key_counts(df, STATE).write.parquet(stored)
    whole = preview.preview_lines(df, STATE, STATE.preview).orderBy(*preview.page_order(STATE, STATE.preview)).collect()
    for page in (5, 9, 12):
        got = preview.preview_page(df, STATE, F.lit(True), page, 500, counts=spark.read.parquet(stored))
        text = plan(got)
        assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(paid_on,[^]]*LessThanOrEqual\(paid_on", text)
        assert text.count("FileScan") == 1
        assert got.collect() == whole[(page - 1) * 500: page * 500]
    first = preview.preview_page(df, STATE, F.lit(True), 1, 500)
    assert plan(first).count("FileScan") == 1
    assert "TakeOrderedAndProject" in plan(first)


def test_spans_of_keys():
    class Counts:
        def __init__(self, *rows):
            self.rows = [type("Row", (), {"key": k, "n": n}) for k, n in rows]

        def collect(self):
            return self.rows

    counts = Counts((None, 4), (2020, 3), (2022, 5), (2021, 2))
    assert preview.page_span(counts, 0, 2) == ([2022], 5, 0)
    assert preview.page_span(counts, 4, 2) == ([2022, 2021], 7, 4)
    assert preview.page_span(counts, 5, 5) == ([2021, 2020], 5, 0)
    assert preview.page_span(counts, 9, 9) == ([2020, None], 7, 2)
    assert preview.page_span(counts, 10, 1) == ([None], 4, 0)
    assert preview.page_span(counts, 14, 1) is None
    assert preview.page_span(Counts(), 0, 1) is None


def test_adaptive_drilldown_scans_once(spark, tmp_path):
    path = str(tmp_path / "city")
    city(spark, [{"company": "w", "org0": "o", "amount": 2, "year": 2020}]).write.parquet(path)
    df = spark.read.parquet(path)
    assert plan(drilldown.drill_seller_adaptive(df, CITY, "w")).count("FileScan") == 1


def test_no_task_orders_the_lines_before_a_page(spark, small, monkeypatch):
    from spendlens.sources.star import state_ledger

    monkeypatch.setattr(preview, "AT_ONCE", 200)
    df = preview.preview_lines(state_ledger(spark, small), STATE, STATE.preview)
    keyed = df.withColumn("_key", preview.page_key(df, STATE, STATE.preview))
    parts = preview.narrow_to_page(keyed, 3000, 50)
    assert sum(p.count() for p in parts) == 50
    limits = [int(n) for p in parts for n in re.findall(r"Limit (\d+)", p._jdf.queryExecution().optimizedPlan().toString())]
    assert limits
    assert max(limits) <= 250


def test_lines_that_look_the_same_are_paged(spark, monkeypatch):
    monkeypatch.setattr(preview, "AT_ONCE", 3)
    df = state(spark, [("A", "s", "t", 1, "2020-01-01", "1", None)] * 10 + [("B", "s", "t", 1, "2020-01-01", "1", None)] * 7)
    got = [[r.buyer for r in preview.preview_page(df, STATE, F.lit(True), p, 6).collect()] for p in (1, 2, 3, 4)]
    assert got == [["A"] * 6, ["A"] * 4 + ["B"] * 2, ["B"] * 5, []]


def test_far_page_with_unknown_days(spark, monkeypatch):
    monkeypatch.setattr(preview, "AT_ONCE", 2)
    df = state(spark, [("A", "s", "t", i, d, "1", None) for i, d in enumerate(["2020-01-01"] * 3 + [None] * 4)])
    got = [preview.preview_page(df, STATE, F.lit(True), p, 2).count() for p in (1, 2, 3, 4, 5)]
    assert got == [2, 2, 2, 1, 0]


def test_vat_tables(spark):
    df = city(spark, [
        {"vat_name": "v", "vat_no": 5}, {"vat_name": " v ", "vat_no": 5}, {"company": "w", "vat_no": 0},
        {"company": "x"}, {"vat_no": 9},
    ])
    got = {(r[0], r[1], r[2] is None) for r in enrich.vat_lookup(df).collect()}
    assert got == {("v", 5, False), ("w", 0, True), ("9", 9, False)}
    assert rows(enrich.vat_coverage(df)) == [(3, 4)]


def test_sellers_of_both_ledgers(spark):
    ours = state(spark, [("A", s, "t", 1, "2020-01-01", "1", None) for s in (" a ", "", None, "b", "b")])
    theirs = city(spark, [{"company_label": "b"}, {"company": "c"}, {}])
    got = [r[0] for r in enrich.all_sellers(ours, theirs, STATE).collect()]
    assert got == ["(óskráð)", "a", "b", "c", None]
    template = enrich.seller_template(ours, STATE)
    assert rows(template, "seller_name") == [("(óskráð)",), ("a",), ("b",)]
    assert rows(enrich.lookup_coverage(template)) == [(3, 0)]
