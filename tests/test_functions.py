from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendlens.functions import (
    active_vat,
    clean,
    extract_entity_id,
    format_amount,
    format_pct,
    iso_date,
    parse_local_number,
    pct_change,
    seller_or_missing,
    supplier_name,
    vat_link,
    year_from_name,
    years_label,
)


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("123.456,78", 123456.78), ("1.234,5", 1234.5), ("-12,5", -12.5), (" 7 ", 7.0), ("\t8 ", 8.0),
        ("", None), ("   ", None), ("abc", None), ("1 234", None), ("1,2,3", None), ("12d", None),
        (None, None), ("1e3", 1000.0), ("+5", 5.0), (",5", 0.5), ("5,", 5.0),
    ],
)
def test_local_number(spark, text, number):
    assert values(spark, [(text,)], "t string", parse_local_number(F.col("t"))) == [number]


def test_formats_agree_with_python(spark):
    numbers = [
        0.0, 0.5, 1.5, 2.5, -0.5, 1234567.5, 1234566.5, -9876543.21, 1e15, 12.25, 12.35, 0.15, 0.25,
        -0.25, 0.05, -0.04, 99.95, 1234.56, -1234.56, 3.0, 2.675,
    ]
    rows = [(n,) for n in numbers]
    assert values(spark, rows, "x double", format_amount(F.col("x"))) == [
        f"{n:,.0f}".replace(",", ".") for n in numbers
    ]
    assert values(spark, rows, "x double", format_pct(F.col("x"))) == [f"{n:+.1f}%" for n in numbers]


def test_missing_numbers_show_a_dash(spark):
    for shown in (format_amount, format_pct):
        assert values(spark, [(None,)], "x double", shown(F.col("x"))) == ["–"]


@pytest.mark.parametrize(
    ("vat_name", "company", "number", "name"),
    [
        (" A ", "B", 1, "A"), ("  ", "B", 1, "B"), (None, "", 12, "12"), (None, None, None, None),
        ("", " ", None, None),
    ],
)
def test_supplier_name(spark, vat_name, company, number, name):
    rows = [(vat_name, company, number)]
    schema = "vat_name string, company string, vat_no bigint"
    assert values(spark, rows, schema, supplier_name()) == [name]


def test_missing_seller_label(spark):
    rows = [(" a ",), ("  ",), (None,)]
    assert values(spark, rows, "s string", seller_or_missing(F.col("s"))) == ["a", "(óskráð)", "(óskráð)"]
    assert values(spark, rows, "s string", clean(F.col("s"))) == ["a", None, None]


def test_year_from_name(spark):
    rows = [("annual_2023.csv",), ("1999-2004",), ("x1800",), ("",), (None,)]
    assert values(spark, rows, "n string", year_from_name(F.col("n"))) == [2023, 1999, None, None, None]


def test_only_the_latest_year_is_starred(spark):
    df = spark.createDataFrame([(2020,), (2022,), (2021,)], "year int")
    assert {r[0] for r in df.select(years_label()).collect()} == {"2020", "2021", "2022*"}


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2024-02-29", dt.date(2024, 2, 29)), ("2024-02-29 10:11:12", dt.date(2024, 2, 29)),
        ("2024-02-29T10:11:12", dt.date(2024, 2, 29)), ("29.02.2024", dt.date(2024, 2, 29)),
        ("2023-02-29", None), ("", None), (None, None),
    ],
)
def test_iso_date(spark, text, day):
    assert values(spark, [(text,)], "d string", iso_date(F.col("d"))) == [day]


@pytest.mark.parametrize(
    ("answer", "number"),
    [
        ('{"vat":[]}', None),
        ('{"vat":[{"vatNumber":"1","deRegistered":"2020"},{"vatNumber":"2","deRegistered":null}]}', "2"),
        ('{"vat":[{"vatNumber":"1","deRegistered":"2020"},{"vatNumber":"2","deRegistered":"2021"}]}', "1"),
        ('{"vat":[{"note":"x"},{"vatNumber":"3"}]}', "3"),
        ('{"vat":[{"note":"x"},{"vatNumber":"3","deRegistered":"2020"}]}', None),
        ('{"vat":[{"vatNumber":"4","deRegistered":""}]}', "4"),
        ('{"vat":[{"vatNumber":"1","deRegistered":"2020"},{"vatNumber":"2","deRegistered":false}]}', "2"),
        ('{"vat":[{"vatNumber":"1","deRegistered":true},{"vatNumber":"2","deRegistered":0}]}', "2"),
        ('{"vat":[{"vatNumber":55}]}', "55"),
        ('{"vat":"no list"}', None), ("{}", None), ("no json", None), (None, None),
    ],
)
def test_active_vat(spark, answer, number):
    assert values(spark, [(answer,)], "a string", active_vat(F.col("a"))) == [number]


@pytest.mark.parametrize(
    ("text", "entity"),
    [
        ("kt. 5501691269, 1234567890", "5501691269"), ("12345678901", None), ("é1234567890", None),
        ("x-1234567890.", "1234567890"), ("", None), (None, None),
    ],
)
def test_entity_id(spark, text, entity):
    assert values(spark, [(text,)], "t string", extract_entity_id(F.col("t"))) == [entity]


def test_link_of_a_missing_number_is_missing(spark):
    got = values(spark, [(7,), (None,)], "n bigint", vat_link(F.col("n")))
    assert got[0].endswith("/vsk-numer/7")
    assert got[1] is None


@pytest.mark.parametrize(
    ("current", "previous", "pct"),
    [(15, 10, 50.0), (5, -10, 150.0), (5, 0, None), (5, None, None), (None, 5, None)],
)
def test_pct_change(spark, current, previous, pct):
    schema = "c decimal(18,2), p decimal(18,2)"
    from decimal import Decimal

    rows = [tuple(None if v is None else Decimal(v) for v in (current, previous))]
    assert values(spark, rows, schema, pct_change(F.col("c"), F.col("p"))) == [pct]
