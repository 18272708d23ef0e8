"""What the optimizer must make of the operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spendlens.operators import anomalies, corrections, totals, yoy
from spendlens.operators.filters import Selection, keep_lines, year_is
from spendlens.sources import open_ledger, write_by_year, write_table
from spendlens.sources.star import city_ledger, state_ledger
from spendlens.spec import CITY, STATE


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    """Stored ledgers: (state by year, state in one table, city)."""
    base = tmp_path_factory.mktemp("stored")
    by_year, flat, city = (str(base / n) for n in ("by_year", "flat", "city"))
    write_by_year(state_ledger(spark, small), by_year, STATE)
    write_table(state_ledger(spark, small).drop("year"), flat)
    write_table(city_ledger(spark, small), city)
    return (
        open_ledger(spark, by_year, STATE), open_ledger(spark, flat, STATE), open_ledger(spark, city, CITY),
    )


@pytest.fixture
def no_broadcast(spark):
    """Force the plan large tables get."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_year_prunes_partitions(stored):
    text = plan(totals.breakdown(stored[0], STATE, "type", Selection(year=1998).predicate(STATE)))
    assert "PartitionFilters: [isnotnull(year" in text
    assert "TakeOrderedAndProject" in text
    assert "ReadSchema: struct<type:string,amount:decimal(18,2),paid_on:date,is_correction:boolean>" in text


def test_year_of_a_date_reaches_the_scan(stored):
    text = plan(stored[1].filter(year_is(STATE, 1998)).groupBy("type").count())
    assert "GreaterThanOrEqual(paid_on,1998-01-01)" in text
    assert "LessThan(paid_on,1999-01-01)" in text


def test_large_amounts_reach_the_scan(stored):
    text = plan(corrections.corrected_invoices(stored[1], STATE))
    assert text.count("GreaterThan(amount,") >= 2
    assert text.count("LessThan(amount,") >= 2
    assert "CartesianProduct" not in text
    assert "NestedLoop" not in text


def test_city_keys_are_an_equi_join(stored, no_broadcast):
    text = plan(corrections.flag_city_corrections(stored[2], CITY))
    assert "SortMergeJoin LeftOuter" in text
    assert "NestedLoop" not in text
    assert "CartesianProduct" not in text


def test_lines_below_the_threshold_are_not_shuffled(stored, no_broadcast):
    df = stored[2].withColumn("marker", F.col("company_label"))
    text = plan(corrections.flag_city_corrections(df, CITY))
    shuffles = [part for part in text.split("\n\n") if ") Exchange" in part.split("\n")[0]]
    assert len(shuffles) == 4  # cells, messages, and both sides of the lookup
    assert "(1) Scan parquet" in text


def test_yoy_takes_two_shuffles_and_no_join(stored, no_broadcast):
    for df, spec in ((stored[1], STATE), (stored[2], CITY)):
        text = plan(yoy.year_over_year(df, spec))
        assert text.count("hashpartitioning") == 2
        assert "Join" not in text
        assert "partial_sum" in text


def test_sums_are_combined_before_the_shuffle(stored):
    for df in (
        totals.headline_yearly(stored[0], STATE),
        totals.by_group(stored[0].filter(keep_lines(STATE)), STATE, "seller"),
        anomalies.by_group_and_year(yoy.year_over_year(stored[1], STATE), "buyer", F.lit(True)),
    ):
        assert "partial_sum" in plan(df)


def test_one_scan_serves_all_breakdowns(stored):
    sections = {"type": "type0", "buyer": "org0", "seller": CITY.seller}
    text = plan(totals.breakdowns(stored[2], CITY, sections, F.lit(True)))
    assert text.count(") Scan parquet") == 1
    assert text.count(") WindowGroupLimit") == 2  # in each task, then for all
    assert "partial_sum" in text


def test_a_hot_invoice_is_one_lookup(stored, no_broadcast):
    hits = stored[1].select("invoice").distinct()
    text = plan(corrections.flag_by_invoice(stored[1], STATE, hits))
    assert "SortMergeJoin LeftOuter" in text


def test_no_python_in_any_operator_plan(stored):
    for df in (
        yoy.year_over_year(stored[2], CITY),
        corrections.flag_state_corrections(stored[1], STATE),
        totals.breakdown(stored[2], CITY, CITY.seller, F.lit(True)),
    ):
        text = plan(df)
        assert "Python" not in text
        assert "Pandas" not in text


def test_star_reads_only_what_is_asked(spark, small):
    text = plan(state_ledger(spark, small, ["year", "amount"]))
    assert "Join" not in text
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in text


def test_a_hot_cell_is_split(spark):
    """AQE splits the lookup of a cell that holds most of the lines."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        n = 60_000
        hot = F.col("id") % 3 != 0
        df = spark.range(0, n, 1, 8).select(
            F.lit(2020).alias("year"),
            F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("company"),
            *(F.lit(None).cast("string").alias(k) for k in corrections.CITY_KEYS if k != "company"),
            F.when(F.col("id") % 2 == 0, 9000).otherwise(-9000).cast("decimal(18,2)").alias("amount"),
            F.concat(F.lit("name"), F.xxhash64("id").cast("string")).alias("vat_name"),
        )
        flagged = corrections.flag_city_corrections(df, CITY, threshold=5000, tolerance=1000)
        assert flagged.filter("is_correction").count() == n * 2 // 3
        counted = flagged.groupBy("is_correction").count()
        counted.collect()
        assert "skew=true" in plan(counted)
    finally:
        for key in settings:
            spark.conf.unset(key)
