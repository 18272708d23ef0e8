from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F

from spendlens.operators import corrections as C
from spendlens.session import SHUFFLE_CLEANUP, shuffles_removed, stored_once
from spendlens.sources import star
from spendlens.spec import CITY, STATE
from spendlens.streaming import upkeep

from .data import city, rows, state


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain()
    return said.getvalue()


def test_a_cell_goes_to_three_rows_whatever_the_days(spark):
    # correction_pairs_* and flag_corrections_*: ten rows a cell before.
    lines = state(spark, [("A", "s", "t", 9000, "2020-01-01", "1", None)])
    cells = C.matched_cells(
        C.with_cell(lines, STATE, 1000), ["buyer", "seller", "type"], "paid_on", [0, -1, -2], F.lit(True), F.lit(True), 1000
    )
    text = plan(cells)
    assert "Window" in text and "date_add" not in text


def test_city_cells_are_keyed_by_two_numbers(spark):
    row = {"year": 2020, "amount": 9000, "org0": "o", "type0": None, "type1": "x", "is_correction": False}
    lines = city(spark, [row, row | {"amount": -9000}, row | {"type0": "x", "type1": None, "amount": -9000}])
    hit = C.corrected_lines(lines, CITY, threshold=5000, tolerance=1000)
    assert rows(hit.select("type0", "type1").distinct()) == [(None, "x")]
    sent = [x for x in plan(hit).split("\n") if "Exchange hashpartitioning(" in x]
    assert any("_key1" in x for x in sent) and not any("org4" in x or "type4" in x for x in sent)


def test_totals_are_dealt_once_for_sums_and_comparison(spark, tmp_path, monkeypatch):
    # incremental_yoy_city: a shuffle by grain and year, then one by grain.
    written = []
    monkeypatch.setattr(upkeep, "write_yoy", lambda df, *a, **b: written.append(df))
    row = {"year": 2020, "amount": 9, "org0": "o", "is_correction": False}
    upkeep.update_comparison(city(spark, [row, row | {"year": 2021}]), str(tmp_path), CITY)
    assert plan(written[0]).count("Exchange hashpartitioning(") == 1


def test_symmetric_pairs_read_their_lines_once(spark):
    # correction_pairs_symmetric: the ledger was joined four times in one plan, with three names a row.
    first = ("A", "s", "t", 9000, "2020-01-01", "1", None)
    lines = state(spark, [first, ("A", "s", "t", -9000, "2020-01-02", "2", None), ("A", "s", None, -9000, "2020-01-02", "3", None)])
    found = C.corrected_invoices(lines, STATE, threshold=5000, tolerance=1000, symmetric=True)
    text = plan(found)
    assert "_key1" in text and "buyer" not in text and "earlier-invoices" in text
    assert rows(found) == [("1",), ("2",)]


def test_shuffled_rows_go_when_a_job_ends(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP)
    with shuffles_removed(spark):
        assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
    assert spark.conf.get(SHUFFLE_CLEANUP) == before
    kept = stored_once(spark.range(9).repartition(3, "id"), "nine")
    assert rows(kept) == [(i,) for i in range(9)] and spark.conf.get(SHUFFLE_CLEANUP) == before


def test_lines_meet_the_widest_dimension_last(spark, small):
    # Lines were shuffled for suppliers and parts with the names of their orders.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(star.city_ledger(spark, small, ["year", "amount", "org3", "type2", "vat_no"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x for x in text.split("\n") if "Exchange" in x]
    assert any("BroadcastExchange" in x for x in dealt)
    assert [k for x in dealt for k in ("l_partkey", "l_orderkey", "l_suppkey") if k in x] == ["l_orderkey", "l_partkey"]
    assert text.index("Exchange hashpartitioning(l_orderkey") < text.index("Exchange hashpartitioning(l_partkey")


def test_few_years_are_summed_and_compared_at_once(spark, tmp_path, monkeypatch):
    # incremental_yoy_city: totals of all years were shuffled three times, and the files stayed.
    written = []
    monkeypatch.setattr(upkeep, "write_yoy", lambda df, *a, **b: written.append((plan(df), spark.conf.get(SHUFFLE_CLEANUP))))
    row = {"amount": 9, "org0": "o", "is_correction": False}
    upkeep.update_comparison(city(spark, [row | {"year": y} for y in range(2015, 2020)]), str(tmp_path), CITY)
    assert len(written) == 3 and {kept for _, kept in written} == {"true"}
    assert spark.read.parquet(f"{tmp_path}/totals").count() == 5
