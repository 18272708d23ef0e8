"""High-water mark and the month windows of a refresh."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: first day of the published data.
FIRST_DAY = dt.date(2017, 1, 1)


def high_water_mark(
    df: DataFrame, column: str = "paid_on", first: dt.date = FIRST_DAY
) -> DataFrame:
    """One row: the latest date, and the first day of its month."""
    latest = F.coalesce(F.max(F.col(column).cast("date")), F.lit(first))
    return df.agg(latest.alias("max_date")).withColumn(
        "month_start", F.trunc("max_date", "month")
    )


def month_chunks(bounds: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """Split every (start, end) row into calendar months.

    The first and the last month are clipped; a row with start after end
    yields nothing.
    """
    lo, hi = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    months = F.when(
        lo <= hi, F.sequence(F.trunc(lo, "month"), hi, F.expr("interval 1 month"))
    )
    first = F.col("_month")
    return (
        bounds.select(lo.alias("_lo"), hi.alias("_hi"), F.explode(months).alias("_month"))
        .select(
            F.greatest(first, "_lo").alias("chunk_start"),
            F.least(F.last_day(first), "_hi").alias("chunk_end"),
        )
        .withColumn(
            "label",
            F.concat_ws(
                "_",
                F.date_format("chunk_start", "yyyyMMdd"),
                F.date_format("chunk_end", "yyyyMMdd"),
            ),
        )
        .withColumn("from_text", F.date_format("chunk_start", "dd.MM.yyyy"))
        .withColumn("to_text", F.date_format("chunk_end", "dd.MM.yyyy"))
    )


def refresh_window(
    ledger: DataFrame | None, today: dt.date, column: str = "paid_on"
) -> tuple[dt.date, dt.date]:
    """From the start of the latest stored month to today.

    Starting at the month and not at the day lets a refresh replace whole
    month partitions.
    """
    if ledger is None:
        return FIRST_DAY, today
    row = high_water_mark(ledger, column).first()
    return row["month_start"], today
