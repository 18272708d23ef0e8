from __future__ import annotations

import datetime as dt
import gzip
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendlens.sources import chunks, csv, landed

from .data import rows
from .test_cells import plan

HEAD = "Kaupandi,Birgi,Tegund,Upphæð línu,Dags.greiðslu,Númer reiknings\n"


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def widths(found):
    return {r[0] for r in found.records.select(F.size("cells")).collect()}


@pytest.mark.parametrize("sep", [",", ";"])
def test_records_are_read_as_wide_as_they_are(spark, tmp_path, sep):
    # export_ingest, csv_ingest and union_years parsed 128 cells of every record.
    if sep == ",":
        put(tmp_path, "a.csv", HEAD + "A,s,t,1,2020-01-31,1\n")
        assert widths(chunks.open_exports(spark, str(tmp_path))) == {6}
    else:
        put(tmp_path, "a_2020.csv", "ar;raun;samtala0\n2020;1;x\n2020;2\n")
        put(tmp_path, "b_2021.csv", "raun;samtala0;tegund0;ar\n3;x;t;2021\n")
        assert widths(csv.open_years(spark, [str(tmp_path)])) == {4}


def test_headers_of_any_place_and_shape(spark, tmp_path):
    put(tmp_path, "a.csv", (
        "Report of 2020,Tegund\n\n﻿ Kaupandi ,\"Birgi\",\" TEGUND \",Upphæð línu,Dags.greiðslu,\"a\nb\"\n"
        "A,\"s, \"\"x\"\"\nand more\",t,1,2020-01-31,1\n"
        "﻿ Kaupandi ,Birgi, TEGUND ,Upphæð línu,Dags.greiðslu,\"a\nb\"\n"
        "﻿ Kaupandi ,Birgi, TEGUND ,Upphæð línu,Dags.greiðslu,\"a\nb\",,beyond\n"
    ))
    put(tmp_path, "b.csv", HEAD + "B,s,t,2,2020-02-01,2" + ",x" * 200 + "\n")
    put(tmp_path, "c.csv", "no header\n1\n")
    df = chunks.ingest_export(spark, str(tmp_path))
    assert rows(df.select("buyer", "seller", "amount", "paid_on", "invoice")) == sorted([
        ("A", 's, "x"\nand more', Decimal("1.00"), dt.date(2020, 1, 31), None),
        ("﻿ Kaupandi ", "Birgi", None, None, None),
        ("Report of 2020", "Tegund", None, None, None),
        ("B", "s", Decimal("2.00"), dt.date(2020, 2, 1), "2"),
    ], key=repr)
    bad = chunks.export_problems(spark, str(tmp_path)).first()
    assert (bad.without_header, bad.too_wide, bad.unreadable_amounts) == (2, 2, 1)


def test_compressed_files_are_read_and_lines_not_shuffled(spark, tmp_path):
    # csv_ingest and union_years landed plain text, and shuffled every line to the headers of its file.
    put(tmp_path, "a_2020.csv", "raun;samtala0\n1,5;x\n")
    (tmp_path / "b_2021.csv.gz").write_bytes(gzip.compress(b'samtala0;raun\n"y;\nz";2\n'))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = csv.combine_years(spark, [str(tmp_path / n) for n in ("a_2020.csv", "b_2021.csv.gz")])
        text = plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    assert rows(df.select("year", "amount", "org0")) == [(2020, Decimal("1.50"), "x"), (2021, Decimal("2.00"), "y;\nz")]


def test_headers_of_very_many_files_are_not_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landed, "BROADCAST_FILES", 1)
    for k in range(3):
        put(tmp_path, f"{k}_2020.csv", f"raun;samtala0\n{k};x\n")
    assert rows(csv.combine_years(spark, [str(tmp_path)]).select("amount")) == [(Decimal(f"{k}.00"),) for k in range(3)]
