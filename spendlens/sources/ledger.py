"""Opening ledgers and derived tables stored as Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import YOY_AMOUNT_TYPE, LedgerSpec


def open_table(spark: SparkSession, path: str, view: str | None = None) -> DataFrame | None:
    """The Parquet table at ``path``, also as a view; None when absent."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if view:
        df.createOrReplaceTempView(view)
    return df


def conform(df: DataFrame, spec: LedgerSpec) -> DataFrame:
    """Canonical names and types for the columns present in ``df``.

    A number that is none, as a VAT number with a letter, is unknown, as it is
    in landed files; an amount that is none stops the read.
    """
    df = df.toDF(*(spec.canonical(c) for c in df.columns))
    types = {f.name: f.dataType for f in spec.schema.fields}

    def typed(c: str) -> Column:
        column = F.col(f"`{c}`")
        if c not in types:
            return column
        lenient = types[c].typeName() == "long" and df.schema[c].dataType.typeName() == "string"
        return (column.try_cast(types[c]) if lenient else column.cast(types[c])).alias(c)

    return df.select(*(typed(c) for c in df.columns))


def with_year(df: DataFrame, spec: LedgerSpec) -> DataFrame:
    """Add the computed year to a ledger that only has a payment date."""
    if spec.date and spec.year not in df.columns:
        return df.withColumn(spec.year, F.year(spec.date))
    return df


def open_ledger(
    spark: SparkSession, path: str, spec: LedgerSpec, view: str | None = None
) -> DataFrame | None:
    """A ledger in canonical form, with its year; None when absent."""
    df = open_table(spark, path)
    if df is None:
        return None
    df = with_year(conform(df, spec), spec)
    if view:
        df.createOrReplaceTempView(view)
    return df


def open_yoy(spark: SparkSession, path: str, spec: LedgerSpec) -> DataFrame | None:
    """A stored year-over-year table in canonical form; None when absent."""
    df = open_table(spark, path)
    if df is None:
        return None
    df = conform(df, spec)
    amounts = ("actual_real", "prior_real", "yoy_real_change")
    return df.withColumns({c: F.col(c).cast(YOY_AMOUNT_TYPE) for c in amounts})


def anomaly_source(
    spark: SparkSession, flagged: str, everything: str, spec: LedgerSpec
) -> DataFrame | None:
    """The flagged table when it exists, else the full comparison."""
    df = open_yoy(spark, flagged, spec)
    return df if df is not None else open_yoy(spark, everything, spec)


def resolve_column(df: DataFrame, wanted: str, preferred: tuple[str, ...]) -> str:
    """``wanted``, or the first preferred column the table really has."""
    if wanted in df.columns:
        return wanted
    return next((c for c in preferred if c in df.columns), wanted)
