"""Tables that follow the ledger equal those built from all of it."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spendlens.operators.yoy import year_over_year
from spendlens.sources import with_year
from spendlens.spec import CITY, STATE
from spendlens.streaming import (
    follow_months,
    land_delivery,
    read_comparison,
    refresh,
    update_comparison,
)
from spendlens.streaming.deliveries import read_refreshed

from .data import city, rows, state
from .test_plans import plan


def made(spark, seed, months, n=60, flag=(None, False, True)):
    draw = random.Random(seed)
    return state(
        spark,
        [
            (
                draw.choice(("A", "B", None)), draw.choice(("s", None)), draw.choice(("t", "u")),
                draw.choice((None, draw.randint(-500, 500))), f"{draw.choice(months)}-{draw.randint(1, 28):02d}",
                str(i), draw.choice(flag),
            )
            for i in range(n)
        ],
    ).drop("year")


class Followed:
    def __init__(self, spark, tmp_path):
        self.spark = spark
        self.landing, self.target, self.checkpoint, self.base = (
            str(tmp_path / n) for n in ("landing", "target", "checkpoint", "base")
        )
        self.seen = []

    def deliver(self, lines, number):
        land_delivery(lines, self.landing, number)
        refresh(self.spark, self.landing, self.target, self.checkpoint, on_change=self.follow)

    def follow(self, session, months):
        self.seen.append(months)
        follow_months(session, self.target, self.base, months, STATE)

    def check(self):
        stored = with_year(read_refreshed(self.spark, self.target), STATE)
        assert rows(read_comparison(self.spark, self.base, STATE)) == rows(year_over_year(stored, STATE))


def test_follows_deliveries(spark, tmp_path):
    ledger = Followed(spark, tmp_path)
    first = ("2018-03", "2019-01", "2019-12", "2020-01", "2020-07", "2022-05")
    ledger.deliver(made(spark, 1, first, 150), 1)
    ledger.check()
    ledger.deliver(made(spark, 2, ("2019-12", "2020-01"), 12), 2)
    ledger.check()
    ledger.deliver(made(spark, 3, ("2021-02",), 30), 3)
    ledger.check()
    assert ledger.seen[1:] == [["2019-12", "2020-01"], ["2021-02"]]


def test_late_delivery_and_lines_without_a_date_change_nothing(spark, tmp_path):
    ledger = Followed(spark, tmp_path)
    ledger.deliver(made(spark, 4, ("2020-01", "2021-01")), 5)
    ledger.deliver(made(spark, 5, ("2020-01",)), 4)
    ledger.deliver(state(spark, [("A", "s", "t", 7, None, "x", None)]).drop("year"), 6)
    ledger.check()
    assert len(ledger.seen) == 2


def test_a_year_that_loses_all_counted_lines(spark, tmp_path):
    ledger = Followed(spark, tmp_path)
    ledger.deliver(made(spark, 6, ("2020-01", "2021-01", "2022-01"), flag=(None,)), 1)
    ledger.deliver(made(spark, 7, ("2021-01",), 5, flag=(True,)), 2)
    ledger.check()
    years = {r[0] for r in rows(read_comparison(spark, ledger.base, STATE), "year")}
    assert years == {2020, 2022}


def test_repeated_and_cut_off_updates(spark, tmp_path):
    base = str(tmp_path / "base")
    lines = with_year(made(spark, 8, ("2019-05", "2020-05", "2021-05")), STATE)
    update_comparison(lines, base, STATE)
    newer = with_year(made(spark, 9, ("2020-05",)), STATE)
    from spendlens.streaming.upkeep import replace_totals

    assert replace_totals(newer, base, STATE) == [2020]
    update_comparison(newer, base, STATE)
    update_comparison(newer, base, STATE)
    whole = lines.filter("year <> 2020").unionByName(newer)
    assert rows(read_comparison(spark, base, STATE)) == rows(year_over_year(whole, STATE))


def test_city_by_years(spark, tmp_path):
    base = str(tmp_path / "base")
    old = [{"year": y, "amount": y % 7, "org0": "A", "vat_no": y % 2, "is_correction": None} for y in range(2015, 2021)]
    new = [{"year": 2017, "amount": 100, "org0": "A", "vat_no": 0}, {"year": 2017, "amount": None, "org0": None}]
    update_comparison(city(spark, [*old, {"year": None, "amount": 1}]), base, CITY)
    update_comparison(city(spark, new), base, CITY)
    whole = city(spark, [r for r in old if r["year"] != 2017] + new)
    assert rows(read_comparison(spark, base, CITY)) == rows(year_over_year(whole, CITY))


def test_nothing_yet(spark, tmp_path):
    base = str(tmp_path / "base")
    assert read_comparison(spark, base, STATE) is None
    update_comparison(state(spark, []), base, STATE)
    assert read_comparison(spark, base, STATE) is None


def test_only_touched_years_and_months_are_read(spark, tmp_path):
    ledger = Followed(spark, tmp_path)
    ledger.deliver(made(spark, 1, ("2018-03", "2020-07", "2022-05")), 1)
    month = read_refreshed(spark, ledger.target, STATE, ["2020-07"])
    assert "month" in plan(month).split("PartitionFilters:")[1].splitlines()[0]
    totals = spark.read.parquet(f"{ledger.base}/totals").filter(F.col("year").isin(2019, 2020))
    assert "year" in plan(totals).split("PartitionFilters:")[1].splitlines()[0]
