from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spendlens.operators import yoy
from spendlens.operators.filters import AnomalySelection, Selection
from spendlens.plans import (
    analysis_view,
    anomalies_view,
    explorer_view,
    home_view,
    reports_view,
    sellers_view,
    types_view,
)
from spendlens.sources.star import city_ledger, state_ledger
from spendlens.spec import CITY, STATE

from .data import rows


@pytest.fixture(scope="module", params=["state", "city"])
def world(request, spark, small):
    spec, build = (STATE, state_ledger) if request.param == "state" else (CITY, city_ledger)
    ledger = build(spark, small).cache()
    return spec, ledger, yoy.year_over_year(ledger, spec).cache()


def test_home(world):
    spec, ledger, _ = world
    frames = home_view(ledger, spec)
    last = max(rows(frames["yearly"], "year"))[0]
    assert frames["latest"].first()["year"] == last
    assert home_view(None, spec) == {}


def test_explorer(world):
    spec, ledger, _ = world
    frames = explorer_view(ledger, spec, Selection(type="ECONOMY"), page=2, limit=20)
    total = frames["totals"].first()
    parts = frames["breakdowns"].collect()
    assert sum(r["n"] for r in parts if r["section"] == "buyer") == total["n"]
    assert total["pages"] == -(-total["n"] // 20)
    assert {r["section"] for r in parts} == {"type", "buyer", "seller"}
    everything = explorer_view(ledger, spec, Selection())["breakdowns"].collect()
    missing = [r["grp"] for r in everything if r["section"] == "type" and r["grp"] in (None, "Ótilgreint")]
    # Only a city's view names the group of lines without a type.
    assert missing == (["Ótilgreint"] if spec is CITY else [None])
    assert frames["preview"].count() == 20
    assert frames["preview"].columns == list(spec.preview)
    assert ("unit_options" in frames) == (spec is CITY)
    unit = explorer_view(ledger, spec, Selection(seller="nobody"))
    assert unit["totals"].first()["n"] == 0


def test_explorer_unit_filter(spark, small):
    ledger = city_ledger(spark, small)
    frames = explorer_view(ledger, CITY, Selection(unit="NATION_7", sign="pos", show_corrections=True))
    assert frames["totals"].first()["n"] == ledger.filter("org1 = 'NATION_7' AND amount > 0").count()


def test_analysis(world):
    spec, ledger, _ = world
    known = analysis_view(ledger, spec, "buyer", "ASIA", limit=10)
    assert known["preview"].count() == 10
    assert known["latest"].first()["year"] == max(r["year"] for r in known["chart"].collect())
    unknown = analysis_view(ledger, spec, "nonsense", "no such value")
    everything = analysis_view(ledger, spec, "type")
    assert rows(unknown["changes"], "year", "total") == rows(everything["changes"], "year", "total")
    assert unknown["pages"].first() == everything["pages"].first()


def test_anomalies_overview_and_detail(world):
    spec, ledger, table = world
    overview = anomalies_view(ledger, table, spec, selection=AnomalySelection(direction="up"))
    assert {"by_buyer", "by_type", "series"} <= set(overview)
    assert "detail" not in overview
    focus = anomalies_view(ledger, table, spec, "type", "ECONOMY", within="ASIA", limit=5)
    assert {r["grp"] for r in focus["detail"].collect()} == {"ASIA"}
    assert [r["grp"] for r in focus["context"].collect() if r["is_selected"]] == ["ASIA"]
    wrong = anomalies_view(ledger, table, spec, "type", "ECONOMY", within="MOON")
    assert len({r["grp"] for r in wrong["detail"].collect()}) > 1
    without = anomalies_view(None, table, spec, "buyer", "ASIA")
    assert "context" not in without
    assert {r["total"] for r in without["series"].collect()} == {0}


def test_reports(world):
    spec, ledger, _ = world
    frames = reports_view(ledger, spec, "buyer", year="1998*")
    # Lines without a buyer are a group of the totals, and of no comparison.
    buyers = ledger.filter(F.col(spec.year) == 1998).select(spec.buyer).distinct()
    assert frames["top"].count() == buyers.count() == (5 if spec is CITY else 6)
    assert frames["yoy"].count() == 5
    assert sum(r["label"].endswith("*") for r in frames["years"].collect()) == 1
    whole = reports_view(ledger, spec)
    assert sum(r["total"] for r in whole["yearly"].collect()) == ledger.agg({"amount": "sum"}).first()[0]


def test_drilldowns(world):
    spec, ledger, _ = world
    top = types_view(ledger, spec)["rows"].collect()
    value = next(r["grp"] for r in top if r["grp"])
    inner = types_view(ledger, spec, value)["rows"].collect()
    assert sum(r["n"] for r in inner) == next(r["n"] for r in top if r["grp"] == value)
    sellers = sellers_view(ledger, spec, year=1998)["rows"].collect()
    assert [r["total"] for r in sellers] == sorted((r["total"] for r in sellers), reverse=True)
    one = sellers_view(ledger, spec, sellers[0]["grp"], 1998)["rows"].collect()
    assert sum(r["total"] for r in one) == sellers[0]["total"]
