"""Batch jobs.

    python -m spendlens.jobs corrections --kind state --input IN --output OUT
    python -m spendlens.jobs --help
"""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import corrections, enrich, yoy
from .session import build_session
from .sources import (
    catalog_resources,
    combine_chunks,
    combine_years,
    high_water_mark,
    ingest_export,
    month_chunks,
    open_ledger,
    open_yoy,
    refresh_window,
    with_year_in_name,
    write_by_month,
    write_by_year,
    write_table,
    write_yoy,
)
from .sources.chunks import export_problems
from .sources.csv import year_problems
from .spec import CITY, STATE, LedgerSpec
from .streaming import land_delivery, refresh

KINDS: dict[str, LedgerSpec] = {"state": STATE, "city": CITY}


def _open(spark: SparkSession, path: str, spec: LedgerSpec) -> DataFrame:
    df = open_ledger(spark, path, spec)
    if df is None:
        raise SystemExit(f"no ledger at {path}")
    return df


def mark_corrections(
    spark: SparkSession, spec: LedgerSpec, source: str, output: str, threshold: float,
    symmetric: bool = False, keep_layout: bool = False,
) -> None:
    """A ledger with its correction mark, stored by year."""
    df = _open(spark, source, spec)
    if symmetric and spec is not STATE:
        raise SystemExit("--symmetric is for state ledgers: city lines are marked both ways")
    if spec is STATE:
        marked = corrections.flag_state_corrections(df, spec, threshold=threshold, symmetric=symmetric)
    else:
        marked = corrections.flag_city_corrections(df, spec, threshold=threshold)
    write_by_year(marked, output, spec, keep_layout)


def build_anomalies(
    spark: SparkSession, spec: LedgerSpec, source: str, everything: str, flagged: str,
    min_pct: float = 20.0, min_amount: float = 50e6,
) -> None:
    """The full comparison and its flagged part.

    The flagged part is filtered from the stored table, so the comparison is
    computed once and nothing is cached.
    """
    write_yoy(yoy.year_over_year(_open(spark, source, spec), spec), everything, spec)
    table = open_yoy(spark, everything, spec)
    write_yoy(yoy.flag_anomalies(table, min_pct, min_amount), flagged, spec)


def enrich_from_registry(
    spark: SparkSession, state: str, city: str, registry: str, output: str, name: str, answer: str
) -> None:
    """VAT numbers of all sellers from stored registry answers."""
    sellers = enrich.all_sellers(_open(spark, state, STATE), _open(spark, city, CITY), STATE)
    numbers = enrich.registry_numbers(spark.read.parquet(registry), name, answer)
    write_table(enrich.enrich_sellers(sellers, numbers), output)


def build_vat_lookup(spark: SparkSession, spec: LedgerSpec, source: str, output: str) -> DataFrame:
    """The VAT lookup of one ledger; returns its coverage, one row."""
    df = _open(spark, source, spec)
    if spec is STATE:
        lookup = enrich.seller_template(df, spec)
        write_table(lookup, output)
        return enrich.lookup_coverage(spark.read.parquet(output))
    write_table(enrich.vat_lookup(df), output)
    return enrich.vat_coverage(df)


def _whole(lines: DataFrame, spec: LedgerSpec) -> DataFrame:
    """All columns of a ledger; those the files lack are NULL."""
    missing = [f for f in spec.schema.fields if f.name not in lines.columns]
    return lines.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})


def land_exports(spark: SparkSession, source: str, landing: str, number: int) -> dict[str, int]:
    """CSV exports of whole months as one delivery; returns what could not be used."""
    lines = ingest_export(spark, source)
    if lines is None:
        raise SystemExit(f"no lines under {source}")
    land_delivery(_whole(lines, STATE).select(*STATE.schema.names), landing, number)
    return export_problems(spark, source).first().asDict()


def rebuild(spark: SparkSession, landing: str, target: str, checkpoint: str) -> None:
    """The stored ledger anew from all that is landed. Removes ``target`` and ``checkpoint``."""
    for folder in (target, checkpoint):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    refresh(spark, landing, target, checkpoint)


def run_pipeline(
    spark: SparkSession, landing: str, base: str, threshold: float = corrections.THRESHOLD,
    min_pct: float = 20.0, min_amount: float = 50e6, reset: bool = False,
) -> None:
    """Landed state deliveries to marked ledger and anomaly tables."""
    (rebuild if reset else refresh)(spark, landing, f"{base}/ledger", f"{base}/checkpoint")
    _mark_and_compare(spark, STATE, base, threshold, min_pct, min_amount)


def run_city_pipeline(
    spark: SparkSession, files: list[str], base: str, threshold: float = corrections.THRESHOLD,
    min_pct: float = 20.0, min_amount: float = 50e6,
) -> dict[str, int]:
    """Yearly CSVs to marked ledger and anomaly tables; returns what could not be used."""
    write_by_year(_whole(combine_years(spark, files), CITY), f"{base}/ledger", CITY)
    _mark_and_compare(spark, CITY, base, threshold, min_pct, min_amount)
    return year_problems(spark, files).first().asDict()


def _mark_and_compare(
    spark: SparkSession, spec: LedgerSpec, base: str, threshold: float, min_pct: float, min_amount: float
) -> None:
    mark_corrections(spark, spec, f"{base}/ledger", f"{base}/marked", threshold)
    build_anomalies(
        spark, spec, f"{base}/marked", f"{base}/anomalies_all", f"{base}/anomalies_flagged",
        min_pct, min_amount,
    )


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="spendlens.jobs", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *required: str, kind: bool = False) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for option in required:
            sub.add_argument(f"--{option}", required=True)
        if kind:
            sub.add_argument("--kind", choices=sorted(KINDS), required=True)
        return sub

    day = dt.date.fromisoformat
    command("ingest-exports", "input", "output")
    command("combine", "output").add_argument("inputs", nargs="+")
    command("ingest-city", "output").add_argument("files", nargs="+")
    sub = command("corrections", "input", "output", kind=True)
    sub.add_argument("--threshold", type=float, default=corrections.THRESHOLD)
    sub.add_argument("--symmetric", action="store_true")
    sub.add_argument("--keep-layout", action="store_true", help="the input is stored by year")
    sub = command("anomalies", "input", "output-all", "output-flagged", kind=True)
    sub.add_argument("--min-pct", type=float, default=20.0)
    sub.add_argument("--min-amount", type=float, default=50e6)
    command("vat-lookup", "input", "output", kind=True)
    sub = command("enrich", "state", "city", "registry", "output")
    sub.add_argument("--name-column", default="name")
    sub.add_argument("--answer-column", default="answer")
    sub = command("high-water", "input")
    sub.add_argument("--column", default="paid_on")
    sub = command("months")
    sub.add_argument("--from", dest="start", type=day)
    sub.add_argument("--to", dest="end", type=day, default=dt.date.today())
    sub.add_argument("--ledger")
    sub = command("catalog", "input")
    sub.add_argument("--column", default="value")
    sub.add_argument("--years", default="")
    command("land-exports", "input", "landing").add_argument("--number", type=int, required=True)
    sub = command("refresh", "landing", "target", "checkpoint")
    sub.add_argument("--reset", action="store_true", help="rebuild from all that is landed")
    whole = command("pipeline", "landing", "base")
    whole.add_argument("--reset", action="store_true", help="rebuild from all that is landed")
    city = command("city-pipeline", "base")
    city.add_argument("files", nargs="+")
    for sub in (whole, city):
        sub.add_argument("--threshold", type=float, default=corrections.THRESHOLD)
        sub.add_argument("--min-pct", type=float, default=20.0)
        sub.add_argument("--min-amount", type=float, default=50e6)
    return parser


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = spark or build_session()
    spec = KINDS.get(getattr(args, "kind", ""), STATE)
    match args.command:
        case "ingest-exports":
            lines = ingest_export(spark, args.input)
            if lines is None:
                raise SystemExit(f"no lines under {args.input}")
            write_by_month(lines, args.output)
            print(export_problems(spark, args.input).first().asDict())
        case "land-exports":
            print(land_exports(spark, args.input, args.landing, args.number))
        case "combine":
            combine_chunks(spark, args.inputs, args.output)
        case "ingest-city":
            write_by_year(combine_years(spark, args.files), args.output, CITY)
            print(year_problems(spark, args.files).first().asDict())
        case "corrections":
            mark_corrections(spark, spec, args.input, args.output, args.threshold, args.symmetric, args.keep_layout)
        case "anomalies":
            build_anomalies(
                spark, spec, args.input, args.output_all, args.output_flagged, args.min_pct, args.min_amount
            )
        case "vat-lookup":
            print(build_vat_lookup(spark, spec, args.input, args.output).first().asDict())
        case "enrich":
            enrich_from_registry(
                spark, args.state, args.city, args.registry, args.output, args.name_column, args.answer_column
            )
        case "high-water":
            ledger = open_ledger(spark, args.input, STATE)
            empty = spark.createDataFrame([], f"{args.column} date")
            row = high_water_mark(empty if ledger is None else ledger, args.column).first()
            print(row["max_date"].isoformat(), row["month_start"].isoformat())
        case "months":
            start = args.start
            if start is None:
                known = open_ledger(spark, args.ledger, STATE) if args.ledger else None
                start, _ = refresh_window(known, args.end)
            bounds = spark.createDataFrame([(start, args.end)], "a date, b date")
            for row in month_chunks(bounds, "a", "b").orderBy("chunk_start").collect():
                print(row["label"], row["from_text"], row["to_text"])
        case "catalog":
            answers = spark.read.text(args.input, wholetext=True)
            found = catalog_resources(answers, args.column)
            if args.years:
                found = with_year_in_name(found, args.years.split(","))
            for row in found.orderBy("name", "url").toLocalIterator():
                print(row["name"], row["url"])
        case "refresh":
            (rebuild if args.reset else refresh)(spark, args.landing, args.target, args.checkpoint)
        case "pipeline":
            run_pipeline(
                spark, args.landing, args.base, args.threshold, args.min_pct, args.min_amount, args.reset
            )
        case "city-pipeline":
            print(run_city_pipeline(
                spark, args.files, args.base, args.threshold, args.min_pct, args.min_amount
            ))


__all__ = [
    "build_anomalies", "build_vat_lookup", "enrich_from_registry", "land_exports", "main",
    "mark_corrections", "rebuild", "run_city_pipeline", "run_pipeline",
]

if __name__ == "__main__":
    main()
