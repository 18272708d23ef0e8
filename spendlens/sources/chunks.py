"""Monthly export chunks of a state ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import iso_date
from ..spec import STATE, LedgerSpec
from .landed import Landed
from .ledger import conform
from .sinks import write_table


def _amount(text: Column) -> Column:
    return F.trim(text).try_cast("decimal(18,2)")


def open_exports(spark: SparkSession, path: str, spec: LedgerSpec = STATE) -> Landed:
    return Landed(spark, [path], ",", spec, lambda name: spec.canonical(name.strip()))


def export_problems(spark: SparkSession, path: str, spec: LedgerSpec = STATE) -> DataFrame:
    """One row that counts what ``ingest_export`` cannot use; see ``Landed.problems``."""
    return open_exports(spark, path, spec).problems(_amount)


def ingest_export(spark: SparkSession, path: str, spec: LedgerSpec = STATE) -> DataFrame | None:
    """The CSV exports under ``path`` with explicit types.

    None when no file has a header. What a file holds decides, never its size:
    every record under a header is a line.
    """
    landed = open_exports(spark, path, spec)
    if not landed.layouts:
        return None
    df = landed.lines().drop("_file")
    if spec.date in df.columns:
        df = df.withColumn(spec.date, iso_date(F.col(spec.date)))
    df = df.withColumn(spec.amount, _amount(F.col(spec.amount)))
    if spec.flag in df.columns:
        df = df.withColumn(spec.flag, F.lower(F.trim(spec.flag)).try_cast("boolean"))
    return conform(df, spec)


def _open_chunks(spark: SparkSession, paths: Sequence[str], spec: LedgerSpec) -> DataFrame:
    """Chunks of one schema in one scan; the folders of a partitioned table are columns."""
    frames = [conform(spark.read.parquet(p), spec) for p in paths]
    df = frames[0]
    for other in frames[1:]:
        df = df.unionByName(other, allowMissingColumns=True)
    return df


def read_chunks(
    spark: SparkSession, paths: list[str], spec: LedgerSpec = STATE, same_layout: bool = False
) -> DataFrame:
    """UNION ALL of Parquet chunks.

    Every chunk is opened by its own footer and cast, as the types of older
    chunks were guessed one by one; a column a chunk lacks is NULL there, and
    the folders of a partitioned chunk are columns. With ``same_layout`` all
    paths are one scan with the schema of the ledger.
    """
    if same_layout:
        return conform(spark.read.parquet(*paths), spec)
    return _open_chunks(spark, paths, spec)


def combine_chunks(
    spark: SparkSession,
    paths: list[str],
    output: str,
    spec: LedgerSpec = STATE,
    same_layout: bool = False,
) -> DataFrame:
    """Write all chunks as one table and return it."""
    if not paths:
        raise ValueError("no chunks to combine")
    write_table(read_chunks(spark, paths, spec, same_layout), output)
    return spark.read.parquet(output)
