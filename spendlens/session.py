"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="spendlens-")


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on.

    Partition sizes come from bytes, not from a core count: AQE coalesces a
    generous number of shuffle partitions and splits the skewed ones. The
    larger code cache serves a session that keeps answering many different
    queries.
    """
    builder = (
        SparkSession.builder.appName("spendlens")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.codegen.cache.maxEntries", "1000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Only a
    local session without that setting gets a temporary folder of its own.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
        base = _local_scratch()
    return f"{base.rstrip('/')}/spendlens/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs begun inside remove what they shuffled as soon as each ends.

    Otherwise shuffled rows fill the disks of the executors until the driver
    happens to collect its garbage, so a query of several writes holds those of all.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stored_once(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a scratch folder, removed when the session's JVM ends, and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
