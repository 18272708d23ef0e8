"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the session's JVM ends."""
    path = scratch_path(spark, label)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: later uses do not compute it again.

    The table lies where all executors reach it, so it outlives lost executors.
    """
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(kept: DataFrame, rows: int = 50_000) -> DataFrame:
    """A kept table, to be broadcast if it has at most so many rows.

    A larger one is joined as Spark sees fit, by a shuffle if need be.
    """
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept
