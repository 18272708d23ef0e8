"""Resources listed in a stored open-data catalog answer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ANSWER = (
    "success boolean, error string, "
    "result struct<resources: array<struct<format:string,url:string,name:string>>>"
)


def catalog_resources(answers: DataFrame, column: str, strict: bool = True) -> DataFrame:
    """CSV resources (url, name) of every answer in ``column``.

    ``strict`` fails the job on an answer that is not successful; otherwise
    such answers are passed over. Resources without a url are left out.
    """
    parsed = answers.select(F.from_json(column, _ANSWER).alias("a"))
    ok = F.coalesce(F.col("a.success"), F.lit(False))
    if strict:
        checked = F.when(ok, True).otherwise(
            F.raise_error(
                F.concat(F.lit("catalog error: "), F.coalesce("a.error", F.lit("unreadable answer")))
            ).cast("boolean")
        )
    else:
        checked = ok
    listed = parsed.filter(checked).select(F.explode("a.result.resources").alias("r"))
    return listed.filter(
        (F.upper("r.format") == "CSV") & (F.coalesce("r.url", F.lit("")) != "")
    ).select(
        F.col("r.url").alias("url"),
        F.coalesce("r.name", F.lit("resource")).alias("name"),
    )


def with_year_in_name(resources: DataFrame, years: Iterable[int | str]) -> DataFrame:
    """Keep the resources whose name contains one of the years."""
    hit = F.lit(False)
    for year in years:
        hit = hit | F.col("name").contains(str(year))
    return resources.filter(hit)
