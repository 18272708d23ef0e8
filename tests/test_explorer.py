"""The explorer's lists in one scan, and search by an index."""

from __future__ import annotations

import pytest

from spendlens.operators import totals
from spendlens.operators.explorer import explorer_sections
from spendlens.operators.filters import Selection, options, search_options, years
from spendlens.operators.option_index import (
    extend_option_index,
    grams_of_search,
    search_index,
    write_option_index,
)
from spendlens.plans import explorer_page
from spendlens.sources import write_table
from spendlens.sources.ledger import open_ledger
from spendlens.sources.star import state_ledger
from spendlens.spec import CITY, STATE

from .data import city, rows, state
from .test_plans import plan

LINES = [
    ("A", "s", "t", 10, "2020-01-05", "1", None),
    ("A", None, "t", -4, "2020-03-05", "2", False),
    ("B", "s", "u", 7, "2021-03-05", "3", None),
    (None, "r", None, 5, "2021-04-05", "4", None),
    ("C", "r", "t", 9, "2021-04-05", "5", True),
    ("B", "s", "t", None, None, "6", None),
]


def section(found, name, *columns):
    return rows(found.filter(f"section = '{name}'"), *columns)


def texts(pairs):
    return sorted(((None if g is None else str(g), *r) for g, *r in pairs), key=repr)


@pytest.mark.parametrize(
    "pick", [Selection(), Selection(year=2020, type="t"), Selection(sign="neg"), Selection(buyer="none")]
)
@pytest.mark.parametrize("top", [1, 30])
def test_sections_equal_the_separate_frames(spark, pick, top):
    ledger = state(spark, LINES)
    found = explorer_sections(ledger, STATE, pick, top)
    where = pick.predicate(STATE)
    for name, column in (("type", "type"), ("buyer", "buyer"), ("seller", "seller")):
        want = rows(totals.breakdown(ledger, STATE, column, where, top), "grp", "total", "n")
        assert section(found, name, "grp", "total", "n") == want
        if name != "seller":
            assert section(found, f"{name}_options", "grp") == rows(options(ledger, column))
    assert section(found, "year_options", "grp") == texts(rows(years(ledger, STATE)))
    every_year = totals.yearly_total(ledger, STATE, pick.predicate(STATE, with_year=False))
    assert section(found, "yearly", "grp", "total") == texts(rows(every_year, "year", "total"))
    columns = ("n", "total", "pos", "neg")
    assert section(found, "totals", *columns) == rows(totals.overall(ledger, STATE, where), *columns)


def test_city_names_units_and_the_missing_type(spark):
    ledger = city(
        spark,
        [
            {"year": 2020, "amount": 3, "org1": "x", "company": " Q "},
            {"year": 2020, "amount": 2, "org1": "y", "type0": "Ótilgreint", "vat_no": 7},
        ],
    )
    found = explorer_sections(ledger, CITY, Selection())
    assert section(found, "unit_options", "grp") == [("x",), ("y",)]
    assert section(found, "type", "grp", "n") == [("Ótilgreint", 1), ("Ótilgreint", 1)]
    assert section(found, "seller", "grp") == [("7",), ("Q",)]


def test_an_empty_ledger_has_totals(spark):
    found = explorer_sections(state(spark, []), STATE, Selection())
    assert rows(found) == [("totals", None, 0, None, None, None)]


def test_one_scan(spark, tmp_path):
    path = str(tmp_path / "ledger")
    write_table(state(spark, LINES).drop("year"), path)
    frames = explorer_page(open_ledger(spark, path, STATE), STATE, Selection(year=2021))
    assert plan(frames["sections"]).count("Location: InMemoryFileIndex") == 1
    assert frames["preview"].count() == 2


NAMES = ["Ísland ohf.", "ÍSLANDSBANKI", "Bánki", "a", "", "ab", "abab", "%_x", "  padded ", None, "Straße 12", "日本語"]


@pytest.mark.parametrize(
    "text", ["", "  ", "ísland", "ÍSLANDS", "b", "ab", "ABA", "bab", "banki", "bánki", "%_", "padded", "straße 1", "本語", "zzz", "ababab"]
)
def test_search_by_index_equals_the_scan(spark, index, text):
    lines, path = index
    want = rows(search_options(lines, "seller", text))
    assert rows(search_index(spark, path, "seller", text)) == want


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    lines = state(spark, [("A", n, "t", 1, "2020-01-01", "1", None) for n in NAMES * 2])
    path = str(tmp_path_factory.mktemp("options") / "index")
    write_option_index(lines, ["seller", "buyer"], path)
    return lines, path


def test_extending_twice_adds_values_once(spark, tmp_path):
    path = str(tmp_path / "index")
    write_option_index(state(spark, [("A", "old", "t", 1, None, "1", None)]), ["seller"], path)
    newer = state(spark, [("A", n, "t", 1, None, "1", None) for n in ("old", "gold", "new")])
    for _ in range(2):
        extend_option_index(newer, ["seller"], path)
    assert rows(search_index(spark, path, "seller", "old")) == [("gold",), ("old",)]
    assert rows(search_index(spark, path, "seller", "")) == [("gold",), ("new",), ("old",)]
    stored = spark.read.parquet(path)
    assert stored.count() == stored.distinct().count()


def test_grams_reach_the_scan(spark, small, tmp_path):
    path = str(tmp_path / "index")
    write_option_index(state_ledger(spark, small, ["seller"]), ["seller"], path)
    text = plan(search_index(spark, path, "seller", "nation_1"))
    assert "PartitionFilters: [isnotnull(column" in text
    assert "In(gram, [" in text
    assert grams_of_search("nation") == ["ati", "ion", "nat", "tio"]
