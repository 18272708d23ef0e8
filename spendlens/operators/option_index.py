"""Search among the values of a column without reading the ledger.

The index has a row per value and *gram*: every one, two and three letters in a
row of the value in lower case, and one empty gram. It is stored by column and
in the order of grams, so a search reads the few row groups with the grams of
its text. A value that contains the text has all of them; that it contains the
text is then checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3


def _grams(value: Column) -> Column:
    def of_length(low: Column, size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(low) - (size - 1))
        cut = F.transform(starts, lambda i: F.substring(low, i, F.lit(size)))
        return F.when(F.length(low) >= size, cut).otherwise(F.array().cast("array<string>"))

    parts = [of_length(F.lower(value), size) for size in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *parts))


def option_grams(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, gram, value) of the values that occur; NULL is none.

    One scan for all columns; a value of very many lines reaches the shuffle
    once per task.
    """
    each = F.array(
        *(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)
    )
    values = df.select(F.inline(each)).filter(F.col("value").isNotNull()).distinct()
    return values.select("column", F.explode(_grams(F.col("value"))).alias("gram"), "value")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    (
        rows.repartitionByRange("column", "gram", "value")
        .sortWithinPartitions("column", "gram", "value")
        .write.mode(mode)
        .option("partitionOverwriteMode", "static")
        .partitionBy("column")
        .parquet(path)
    )


def write_option_index(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """Build the index of these columns anew."""
    _write(option_grams(df, columns), path, "overwrite")


def extend_option_index(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """Add the values of new lines.

    Values that are there already are left out, so repeating it, also after a
    part was written, changes no answer. Values that no line has any more stay
    until the index is built anew.
    """
    stored = df.sparkSession.read.parquet(path)
    _write(option_grams(df, columns).join(stored, ["column", "gram", "value"], "left_anti"), path, "append")


def grams_of_search(text: str) -> list[str]:
    """The grams to look up: all of full length, or the short text itself."""
    if len(text) <= GRAM:
        return [text]
    return sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})


def search_index(spark: SparkSession, path: str, column: str, text: str) -> DataFrame:
    """``filters.search_options`` from the index: sorted values that contain the text.

    Case and outer blanks do not count; a text of nothing finds every value.
    """
    wanted = text.strip().lower()
    grams = grams_of_search(wanted)
    stored = spark.read.schema("gram string, value string, column string").parquet(path)
    return (
        stored.filter((F.col("column") == column) & F.col("gram").isin(grams))
        .filter(F.lower("value").contains(wanted))
        .groupBy("value")
        .agg(F.count_distinct("gram").alias("met"))
        .filter(F.col("met") == len(grams))
        .select(F.col("value").alias(column))
        .orderBy(column)
    )
