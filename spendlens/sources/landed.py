"""Landed CSV files, read by their own headers in one scan.

The dialect is standard: quotes inside quotes are doubled, a quoted field may
hold separators and line breaks, a backslash is a plain character. Such files
are not split, so keep them at a modest size. They may be compressed
(``.csv.gz``, ``.csv.bz2``).

Files may differ in columns and their order, and most of their columns may be
unknown. One pass over the records' texts finds the header of every file (its
first record with two known names), the few distinct layouts and the most cells
of a record; a second one reads as many cells of all records and takes each
column from where the layout of the file has it. The headers are stored, with
the paths of their files, and broadcast up to ``BROADCAST_FILES``: lines are not
shuffled to meet them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import stored_once
from ..spec import LedgerSpec

#: Columns a landed file may have. Records with more are counted as too wide.
WIDTH = 128
#: Files up to which their headers are broadcast.
BROADCAST_FILES = 100_000


def _csv(spark: SparkSession, paths: list[str], sep: str, names: list[str]) -> DataFrame:
    """The fields of every record, and in ``_more`` the text of records of another size."""
    return (
        spark.read.schema(", ".join(f"{n} string" for n in [*names, "_more"]))
        .options(sep=sep, quote='"', escape='"', multiLine=True, columnNameOfCorruptRecord="_more")
        .options(recursiveFileLookup=True, pathGlobFilter="*.csv{,.gz,.bz2}")
        .csv(paths)
        .withColumns({
            "file": F.col("_metadata.file_path"),
            # Files are not split, so a task numbers the records of a file in their order.
            "at": F.monotonically_increasing_id(),
        })
    )


def _names(width: int) -> list[str]:
    return [f"c{i}" for i in range(width)]


def texts(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    """(file, at, text, width) of every record: its text unparsed, and as many cells as it has at most."""
    text = F.coalesce("_more", "c0")
    width = F.least(F.regexp_count(text, F.lit(re.escape(sep))) + 1, F.lit(WIDTH))
    return _csv(spark, paths, sep, _names(1)).select(
        "file", "at", text.alias("text"), F.coalesce(width, F.lit(1)).alias("width")
    )


def records(spark: SparkSession, paths: list[str], sep: str, width: int = WIDTH) -> DataFrame:
    """(file, at, cells, wide) of every record, headers too: ``at`` rises within a file,
    ``wide`` holds for fields that did not fit into ``WIDTH``.

    ``width`` is as many cells as any record has. The parser spends an exception on every
    cell that a record lacks, in time that grows with the width, so it should be close.
    """
    return _csv(spark, paths, sep, _names(width)).select(
        "file",
        "at",
        F.array(*_names(width)).alias("cells"),
        # Short records are kept there too, so separators tell.
        F.coalesce(F.regexp_count("_more", F.lit(re.escape(sep))) >= WIDTH, F.lit(False)).alias("wide"),
    )


def _headers(found: DataFrame, sep: str, known: set[str]) -> DataFrame:
    """(file, cells) of the first record with two known names in each file of ``texts``."""
    # A known name as a whole cell; what may be a header is then parsed.
    names = "|".join(re.escape(n) for n in sorted(known))
    edge = f'[{re.escape(sep)}"]'
    plain = F.lower(F.replace(F.col("text"), F.lit("\ufeff"), F.lit("")))
    maybe = found.filter(plain.rlike(rf"(?:^|{edge})\s*(?:{names})\s*(?:$|{edge})"))
    cells = F.from_csv("text", ", ".join(f"{n} string" for n in _names(WIDTH)), {"sep": sep, "quote": '"', "escape": '"'})
    # One row each: the parsed record is not parsed again for every cell.
    parsed = maybe.select("file", "at", F.inline(F.array(cells)))
    named = parsed.select("file", "at", F.array(*_names(WIDTH)).alias("cells"))
    return (
        named.filter(_known_names(F.col("cells"), known) >= 2)
        .groupBy("file").agg(F.min_by("cells", "at").alias("cells"))
    )


def _known_names(cells: Column, known: set[str]) -> Column:
    plain = F.transform(cells, lambda c: F.lower(F.trim(F.replace(c, F.lit("\ufeff"), F.lit("")))))
    return F.size(F.filter(plain, lambda c: c.isin(sorted(known))))


class Landed:
    """The records below some paths, and the layouts of their files.

    Making one runs jobs; the driver gets one row per distinct header.
    """

    def __init__(
        self,
        spark: SparkSession,
        paths: list[str],
        sep: str,
        spec: LedgerSpec,
        canonical: Callable[[str], str],
        more: tuple[str, ...] = (),
    ) -> None:
        known = {n.lower() for n in (*spec.file_names, *spec.schema.names, *more)}
        self.spec = spec
        seen = Observation()
        watched = texts(spark, paths, sep).observe(seen, F.max("width").alias("width"))
        heads = stored_once(_headers(watched, sep, known), "headers")
        layouts = heads.groupBy("cells").count().collect()
        width = seen.get.get("width") or 1
        self.records = records(spark, paths, sep, width)
        self.layouts = [cells[:width] for cells, _ in layouts]
        heads = heads.select("file", F.slice("cells", 1, width).alias("cells"))
        number = F.lit(None).cast("int")
        for k, cells in enumerate(self.layouts):
            number = F.when(F.to_json("cells") == F.to_json(F.array(*map(F.lit, cells))), k).otherwise(number)
        files = heads.select("file", number.alias("layout"), F.col("cells").alias("head"))
        self.files = F.broadcast(files) if sum(n for _, n in layouts) <= BROADCAST_FILES else files
        self.columns: dict[str, Column] = {}
        for k, cells in enumerate(self.layouts):
            own: dict[str, Column] = {}
            for i, cell in enumerate(cells):
                if cell is not None and cell.strip("﻿ "):
                    name = canonical(cell.replace("﻿", "").strip())
                    own[name] = F.coalesce(own[name], F.col("cells")[i]) if name in own else F.col("cells")[i]
            for name, value in own.items():
                before = self.columns.get(name)
                here = F.when(F.col("layout") == k, value)
                self.columns[name] = here if before is None else here.otherwise(before)

    def lines(self) -> DataFrame:
        """Records that are no header, of files that have one, as text columns and ``_file``."""
        return self._data("inner").select(
            *(c.alias(n) for n, c in self.columns.items()), F.col("file").alias("_file")
        )

    def _data(self, how: str) -> DataFrame:
        # A header repeated inside its file is no line.
        return self.records.join(self.files, "file", how).filter("head is null or cells <> head")

    def problems(self, amount: Callable[[Column], Column]) -> DataFrame:
        """One row: records read, those in files without a header, those with fields
        beyond the header, and amounts that ``amount`` makes null."""
        widths = F.array(*(F.lit(max(i for i, c in enumerate(x) if c is not None) + 1) for x in self.layouts or [["-"]]))
        last = F.array_max(F.transform("cells", lambda c, i: F.when(c.isNotNull(), i + 1)))
        text = self.columns.get(self.spec.amount, F.lit(None).cast("string"))
        return self._data("left").agg(
            F.count(F.lit(1)).alias("records"),
            F.count_if(F.col("layout").isNull()).alias("without_header"),
            F.count_if(F.col("wide") | (last > F.get(widths, F.col("layout")))).alias("too_wide"),
            F.count_if((F.trim(text) != "") & amount(text).isNull()).alias("unreadable_amounts"),
        )
