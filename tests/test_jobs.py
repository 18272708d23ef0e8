from __future__ import annotations

import json

import pytest

from spendlens import jobs
from spendlens.sources import open_ledger, write_by_year
from spendlens.sources.star import city_ledger, state_ledger
from spendlens.spec import CITY, STATE


@pytest.fixture(scope="module")
def base(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("jobs")
    write_by_year(state_ledger(spark, small), f"{folder}/state", STATE)
    write_by_year(city_ledger(spark, small), f"{folder}/city", CITY)
    return str(folder)


@pytest.mark.parametrize("kind", ["state", "city"])
def test_corrections_then_anomalies(spark, base, kind):
    spec = jobs.KINDS[kind]
    jobs.main(["corrections", "--kind", kind, "--input", f"{base}/{kind}", "--output", f"{base}/{kind}-marked",
               "--threshold", "20000"], spark)
    marked = open_ledger(spark, f"{base}/{kind}-marked", spec)
    assert marked.count() == open_ledger(spark, f"{base}/{kind}", spec).count()
    jobs.main(["anomalies", "--kind", kind, "--input", f"{base}/{kind}-marked", "--output-all", f"{base}/{kind}-all",
               "--output-flagged", f"{base}/{kind}-flagged", "--min-amount", "1e5"], spark)
    assert spark.read.parquet(f"{base}/{kind}-flagged").count() <= spark.read.parquet(f"{base}/{kind}-all").count()


def test_lookups(spark, base, capsys):
    jobs.main(["vat-lookup", "--kind", "city", "--input", f"{base}/city", "--output", f"{base}/lookup"], spark)
    jobs.main(["vat-lookup", "--kind", "state", "--input", f"{base}/state", "--output", f"{base}/template"], spark)
    assert "with_vat" in capsys.readouterr().out
    seller = open_ledger(spark, f"{base}/state", STATE).first()["seller"]
    answers = [(seller, json.dumps({"vat": [{"vatNumber": "9"}]}))]
    spark.createDataFrame(answers, "name string, answer string").write.parquet(f"{base}/registry")
    jobs.main(["enrich", "--state", f"{base}/state", "--city", f"{base}/city", "--registry", f"{base}/registry",
               "--output", f"{base}/enriched"], spark)
    found = spark.read.parquet(f"{base}/enriched").filter("vm_numer IS NOT NULL").collect()
    assert [(r["seller_name"], r["vm_numer"]) for r in found] == [(seller, "9")]


def test_calendar(spark, base, capsys):
    jobs.main(["high-water", "--input", f"{base}/state"], spark)
    latest, month = capsys.readouterr().out.split()
    assert month == latest[:8] + "01"
    jobs.main(["high-water", "--input", f"{base}/nothing"], spark)
    assert capsys.readouterr().out.split() == ["2017-01-01", "2017-01-01"]
    jobs.main(["months", "--from", "2020-01-15", "--to", "2020-02-03"], spark)
    assert capsys.readouterr().out.splitlines() == [
        "20200115_20200131 15.01.2020 31.01.2020", "20200201_20200203 01.02.2020 03.02.2020",
    ]


def test_ingest(spark, tmp_path, capsys):
    (tmp_path / "a_2020.csv").write_text("raun;samtala0\n1,5;o\n2,5;p\n", encoding="utf-8")
    jobs.main(["ingest-city", "--output", str(tmp_path / "city"), str(tmp_path / "a_2020.csv")], spark)
    assert open_ledger(spark, str(tmp_path / "city"), CITY).count() == 2
    (tmp_path / "exports").mkdir()
    (tmp_path / "exports" / "e.csv").write_text(
        "Kaupandi,Birgi,Tegund,Upphæð línu,Dags.greiðslu,Númer reiknings\n"
        + "".join(f"A,s,t,{n},2020-0{n}-01,{n}\n" for n in range(1, 6)), encoding="utf-8")
    jobs.main(["ingest-exports", "--input", str(tmp_path / "exports"), "--output", str(tmp_path / "state")], spark)
    assert open_ledger(spark, str(tmp_path / "state"), STATE).count() == 5
    jobs.main(["combine", "--output", str(tmp_path / "one"), str(tmp_path / "state")], spark)
    assert open_ledger(spark, str(tmp_path / "one"), STATE).count() == 5
    (tmp_path / "catalog.json").write_text(json.dumps({"success": True, "result": {"resources": [
        {"format": "CSV", "url": "u", "name": "n2020"}, {"format": "CSV", "url": "v", "name": "n2021"}]}}), encoding="utf-8")
    capsys.readouterr()
    jobs.main(["catalog", "--input", str(tmp_path / "catalog.json"), "--years", "2021"], spark)
    assert capsys.readouterr().out.split() == ["n2021", "v"]
    with pytest.raises(SystemExit):
        jobs.main(["corrections", "--kind", "state", "--input", str(tmp_path / "x"), "--output", "y"], spark)


def test_city_files_to_anomalies(spark, tmp_path, capsys):
    head = "raun;samtala0;tegund0;fyrirtaeki\n"
    for year, amount in ((2020, "100"), (2021, "900,5"), (2022, "900,5")):
        (tmp_path / f"annual_{year}.csv").write_text(head + f'{amount};o;t;"F ""x"""\n-50;o;t;G\n', encoding="utf-8")
    base = str(tmp_path / "city")
    files = [str(tmp_path / f"annual_{y}.csv") for y in (2020, 2021, 2022)]
    jobs.main(["city-pipeline", "--base", base, *files, "--min-amount", "500", "--min-pct", "1000"], spark)
    assert "'records': 6" in capsys.readouterr().out
    assert spark.read.parquet(f"{base}/anomalies_all").count() == 6
    flagged = spark.read.parquet(f"{base}/anomalies_flagged").filter("prior_real > 0").collect()
    assert [(r.year, float(r.actual_real)) for r in flagged] == [(2021, 900.5)]


def test_exports_to_anomalies_and_rebuild(spark, tmp_path, capsys):
    head = "Kaupandi,Birgi,Tegund,Upphæð línu,Dags.greiðslu,Númer reiknings\n"
    folder, landing, base = tmp_path / "in", str(tmp_path / "landing"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.csv").write_text(head + "A,s,t,10,2020-01-31,1\nA,s,t,99,2021-01-31,2\nA,s,t,5,,3\n", encoding="utf-8")
    jobs.main(["land-exports", "--input", str(folder), "--landing", landing, "--number", "1"], spark)
    assert "'records': 3" in capsys.readouterr().out
    for more in ([], ["--reset"]):
        jobs.main(["pipeline", "--landing", landing, "--base", base, "--min-amount", "50", *more], spark)
        assert spark.read.parquet(f"{base}/marked").count() == 3
        assert spark.read.parquet(f"{base}/anomalies_all").count() == 2
    with pytest.raises(SystemExit, match="symmetric"):
        jobs.main(["corrections", "--kind", "city", "--input", f"{base}/marked", "--output", "x", "--symmetric"], spark)
