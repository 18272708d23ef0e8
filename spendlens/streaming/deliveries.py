"""Incremental refresh: delivered months replace stored months.

Deliveries land as Parquet under ``landing/delivery=<n>/``. A file stream picks
up what is new, and every micro-batch overwrites the month partitions it
brings. Overwriting a partition with the same content changes nothing, so a
batch repeated after a failure is harmless; and since each stored line keeps
its delivery number, an old delivery that arrives late never replaces a newer
month. Lines without a date lie in a month of their own, which the newest
delivery that has such lines replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.ledger import conform, open_table
from ..sources.sinks import write_by_month
from ..spec import STATE, LedgerSpec

DELIVERY = "delivery"


def landing_schema(spec: LedgerSpec = STATE) -> T.StructType:
    return T.StructType([*spec.schema.fields, T.StructField(DELIVERY, T.LongType(), True)])


def land_delivery(lines: DataFrame, landing: str, number: int) -> None:
    """Put whole months of lines into the landing folder."""
    lines.write.mode("overwrite").parquet(f"{landing.rstrip('/')}/{DELIVERY}={number}")


#: Folder of lines without a date.
UNDATED = "undated"


def month_of(day: str) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(UNDATED))


def newest_months(
    lines: DataFrame, day: str, stored: DataFrame | None
) -> list[tuple[str, int]]:
    """(Month, delivery) pairs that have to be written.

    Per month the newest delivery wins; a month stored from a newer one is
    passed over. The driver sees one row per delivered month, and only those
    partitions of the stored table are looked at.
    """
    arrived = dict(lines.groupBy(month_of(day)).agg(F.max(DELIVERY)).collect())
    known: dict[str, int] = {}
    if stored is not None:
        month = F.col("month").cast("string")
        known = dict(
            stored.filter(month.isin(list(arrived))).groupBy(month).agg(F.max(DELIVERY)).collect()
        )
    return sorted((m, n) for m, n in arrived.items() if n >= known.get(m, n))


def apply_deliveries(lines: DataFrame, target: str, spec: LedgerSpec = STATE) -> list[str]:
    """Replace the delivered months of the table at ``target``; returns these months.

    ``lines`` holds complete deliveries. The few months and deliveries become a
    filter, so lines are shuffled once, for the layout of the files.
    """
    spark = lines.sparkSession
    pairs = newest_months(lines, spec.date, open_table(spark, target))
    if not pairs:
        return []
    months: dict[int, list[str]] = {}
    for month, number in pairs:
        months.setdefault(number, []).append(month)
    month = month_of(spec.date)
    wanted = reduce(
        lambda a, b: a | b,
        ((F.col(DELIVERY) == n) & month.isin(found) for n, found in months.items()),
    )
    fresh = lines.filter(wanted).select(*spec.schema.names, DELIVERY)
    write_by_month(fresh, target, spec.date, UNDATED)
    return [month for month, _ in pairs]


def refresh(
    spark: SparkSession,
    landing: str,
    target: str,
    checkpoint: str,
    spec: LedgerSpec = STATE,
    files_per_batch: int | None = None,
    on_change: Callable[[SparkSession, list[str]], None] | None = None,
) -> None:
    """Process everything that has landed since the last call, then stop.

    The stream says which deliveries have new files; each of them is then read
    whole, so a delivery cut in two by a batch limit still replaces its months
    completely. ``checkpoint`` remembers what was processed; keep it between
    calls. Removing it and ``target`` rebuilds the table from all that is
    landed.

    ``on_change`` is told the months each batch has replaced, to bring tables
    derived from the ledger up to date. It must bear being called again with
    the same months: a batch lost before its end is repeated whole.
    """
    schema = landing_schema(spec)

    def on_batch(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        numbers = [r[0] for r in batch.select(DELIVERY).distinct().collect()]
        if numbers:
            whole = session.read.schema(schema).parquet(landing)
            changed = apply_deliveries(whole.filter(F.col(DELIVERY).isin(numbers)), target, spec)
            if on_change and changed:
                on_change(session, changed)

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.parquet(landing)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_refreshed(
    spark: SparkSession, target: str, spec: LedgerSpec = STATE, months: Iterable[str] | None = None
) -> DataFrame:
    """The refreshed ledger without its bookkeeping columns, or some months of it."""
    stored = spark.read.parquet(target)
    if months is not None:
        stored = stored.filter(F.col("month").cast("string").isin(list(months)))
    return conform(stored, spec).drop("month", DELIVERY)
