from __future__ import annotations

from pyspark.sql import functions as F

from spendlens import jobs
from spendlens.sources import open_ledger
from spendlens.spec import STATE
from spendlens.streaming import land_delivery, refresh
from spendlens.streaming.deliveries import read_refreshed

from .data import rows, state


def lines(spark, *made):
    return state(spark, [("A", "s", "t", a, d, i, None) for a, d, i in made]).drop("year")


def stored(spark, target):
    return rows(read_refreshed(spark, target), "paid_on", "invoice")


def places(tmp_path):
    return str(tmp_path / "landing"), str(tmp_path / "target"), str(tmp_path / "checkpoint")


def test_newer_months_replace_older_ones(spark, tmp_path):
    landing, target, checkpoint = places(tmp_path)
    land_delivery(lines(spark, (1, "2020-01-10", "a"), (2, "2020-02-10", "b")), landing, 1)
    refresh(spark, landing, target, checkpoint)
    land_delivery(lines(spark, (2, "2020-02-10", "b2"), (3, "2020-02-20", "c"), (4, "2020-03-01", "d")), landing, 2)
    refresh(spark, landing, target, checkpoint)
    assert [i for _, i in stored(spark, target)] == ["a", "b2", "c", "d"]
    refresh(spark, landing, target, checkpoint)
    assert [i for _, i in stored(spark, target)] == ["a", "b2", "c", "d"]


def test_late_old_delivery_does_not_win(spark, tmp_path):
    landing, target, checkpoint = places(tmp_path)
    land_delivery(lines(spark, (1, "2020-01-10", "new")), landing, 5)
    refresh(spark, landing, target, checkpoint)
    land_delivery(lines(spark, (1, "2020-01-10", "old"), (1, "2019-12-10", "only")), landing, 4)
    refresh(spark, landing, target, checkpoint)
    assert [i for _, i in stored(spark, target)] == ["only", "new"]


def test_lines_without_a_date_are_kept(spark, tmp_path):
    landing, target, checkpoint = places(tmp_path)
    land_delivery(lines(spark, (1, "2020-01-10", "a"), (2, None, "b"), (3, None, "c")), landing, 1)
    refresh(spark, landing, target, checkpoint)
    assert sorted(i for _, i in stored(spark, target)) == ["a", "b", "c"]
    land_delivery(lines(spark, (4, "2020-02-10", "d")), landing, 2)
    land_delivery(lines(spark, (2, None, "b2")), landing, 3)
    refresh(spark, landing, target, checkpoint)
    assert sorted(i for _, i in stored(spark, target)) == ["a", "b2", "d"]
    assert open_ledger(spark, target, STATE).filter("year is null").count() == 1


def test_lost_checkpoint_and_cut_deliveries_change_nothing(spark, tmp_path):
    landing, target, _ = places(tmp_path)
    made = [(n, f"2020-01-{1 + n % 28:02d}", str(n)) for n in range(60)]
    land_delivery(lines(spark, *made).repartition(4), landing, 1)
    land_delivery(lines(spark, *((n, d, f"x{i}") for n, d, i in made)).repartition(4), landing, 2)
    for attempt in range(2):
        refresh(spark, landing, target, str(tmp_path / f"checkpoint{attempt}"), files_per_batch=3)
        assert sorted(i for _, i in stored(spark, target)) == sorted(f"x{n}" for n in range(60))


def test_stream_equals_batch(spark, tmp_path, small):
    from spendlens.sources.star import state_ledger

    landing, base = str(tmp_path / "landing"), str(tmp_path / "base")
    whole = state_ledger(spark, small)
    land_delivery(whole.drop("year").filter("paid_on < '1998-03-20'"), landing, 1)
    land_delivery(whole.drop("year").filter("paid_on >= '1998-03-01'"), landing, 2)
    jobs.main(["pipeline", "--landing", landing, "--base", base, "--threshold", "50000"], spark)
    columns = ("buyer", "seller", "type", "amount", "paid_on", "invoice", "year")
    assert rows(read_refreshed(spark, f"{base}/ledger").withColumn("year", F.year("paid_on")), *columns) == rows(whole, *columns)
    marked = open_ledger(spark, f"{base}/marked", STATE)
    assert marked.count() == whole.count()
    everything = spark.read.parquet(f"{base}/anomalies_all")
    flagged = spark.read.parquet(f"{base}/anomalies_flagged")
    assert 0 < flagged.count() < everything.count()
