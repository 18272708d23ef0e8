"""Years and calendar text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_YEAR = r"(19|20)\d{2}"


def year_from_name(name: Column) -> Column:
    """First year between 1900 and 2099 found in a name, else NULL."""
    return F.nullif(F.regexp_extract(name, _YEAR, 0), F.lit("")).cast("int")


def year_label(year: Column, latest: Column) -> Column:
    """The year as text, with ``*`` on the latest, still incomplete one."""
    return F.concat(year.cast("string"), F.when(year == latest, F.lit("*")).otherwise(F.lit("")))


def years_label(year: str = "year") -> Column:
    """``year_label`` over a frame that has one row per year.

    The unpartitioned window is safe only there: the input is already
    aggregated to a handful of rows.
    """
    return year_label(F.col(year), F.max(year).over(Window.partitionBy()))


def export_date(day: Column) -> Column:
    return F.date_format(day, "dd.MM.yyyy")


def iso_date(text: Column) -> Column:
    """``yyyy-MM-dd`` or ``dd.MM.yyyy`` text as a date, NULL if neither."""
    head = F.split_part(F.replace(F.trim(text), F.lit("T"), F.lit(" ")), F.lit(" "), F.lit(1))
    return F.coalesce(
        F.try_to_date(head, "yyyy-MM-dd"),
        F.try_to_date(head, "dd.MM.yyyy"),
    )
