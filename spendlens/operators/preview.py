"""Pages of ledger lines.

The first pages are a plain top-k in one pass. For any other page the number of
lines per day (or year) tells which days it lies in: they are few numbers,
counted once per filter or stored with the ledger (``key_counts``). Only the
lines of these days are read, as a range that reaches the Parquet reader, and
ordered. Where the page lies deep in a single large day or year, its lines are
split at a few boundary lines drawn from them at random (any will do: they are
drawn once and the result does not depend on them); the exact number of lines
between two boundaries tells between which of them the page lies, and only
those lines are split again, until so few are left that a top-k orders them. No
task holds all the lines before a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import LedgerSpec

MAX_PAGE = 500
#: Lines up to the end of a page that a task keeps of its own to find it in one pass.
SHALLOW = 1_000
#: Lines among which a page is ordered in one task.
AT_ONCE = 20_000
#: Boundaries drawn at a time.
BOUNDARIES = 31


def clamp_limit(limit: int) -> int:
    """The page size of the application."""
    return max(1, min(MAX_PAGE, int(limit)))


def page_order(spec: LedgerSpec, columns: tuple[str, ...]) -> list[Column]:
    """Newest payment first, then every shown column: a total order up to
    lines that look the same, so pages never overlap."""
    first = F.col(spec.date or spec.year).desc_nulls_last()
    return [first, *(F.col(c).asc_nulls_first() for c in columns)]


def page_key(df: DataFrame, spec: LedgerSpec, columns: tuple[str, ...]) -> Column:
    """A struct that rises along ``page_order``; nulls come first inside structs."""
    first = F.col(spec.date or spec.year)
    number = F.unix_date(first) if spec.date else first
    return F.struct(first.isNull().alias("none"), (-number).alias("back"), *columns)


def preview_lines(df: DataFrame, spec: LedgerSpec, columns: tuple[str, ...]) -> DataFrame:
    if "supplier_name" in columns:
        df = df.withColumn("supplier_name", spec.seller)
    return df.select(*columns)


def key_counts(df: DataFrame, spec: LedgerSpec, where: Column | None = None) -> DataFrame:
    """(key, n): lines per day, or per year of a ledger without dates.

    A row per day, whatever the ledger's size. Stored with a ledger it serves
    all its unfiltered pages.
    """
    lines = df if where is None else df.filter(where)
    return lines.groupBy(F.col(spec.date or spec.year).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def page_span(counts: DataFrame, offset: int, limit: int) -> tuple[list, int, int] | None:
    """Keys that hold a page, how many lines they have, and how many of these come before it."""
    rows = sorted(((r.key, r.n) for r in counts.collect()), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    keys, before, within = [], 0, 0
    for key, n in rows:
        if keys and before + within >= offset + limit:
            break
        if not keys and before + n <= offset:
            before += n
            continue
        keys.append(key)
        within += n
    return (keys, within, offset - before) if keys else None


def in_span(spec: LedgerSpec, keys: list) -> Column:
    """Lines whose first sort key lies among neighbouring ``keys``, as a range."""
    column = F.col(spec.date or spec.year)
    known = [k for k in keys if k is not None]
    if not known:
        return column.isNull()
    inside = (column >= F.lit(known[-1])) & (column <= F.lit(known[0]))
    return inside | column.isNull() if None in keys else inside


def preview_page(
    df: DataFrame,
    spec: LedgerSpec,
    where: Column,
    page: int = 1,
    limit: int = 50,
    columns: tuple[str, ...] | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """One page of lines, newest first; ``counts`` are the stored ones of these lines, if any."""
    columns = columns or spec.preview
    offset = (max(1, int(page)) - 1) * limit
    lines = preview_lines(df.filter(where), spec, columns)
    order = page_order(spec, columns)
    if offset + limit <= SHALLOW:
        return lines.orderBy(*order).offset(offset).limit(limit)
    span = page_span(key_counts(df, spec, where) if counts is None else counts, offset, limit)
    if span is None:
        return lines.limit(0)
    keys, n, skip = span
    near = preview_lines(df.filter(where & in_span(spec, keys)), spec, columns)
    if min(n, skip + limit) <= AT_ONCE:
        return near.orderBy(*order).offset(skip).limit(limit)
    keyed = near.withColumn("_key", page_key(df, spec, columns))
    found, *more = (p.drop("_key") for p in narrow_to_page(keyed, skip, limit))
    for part in more:
        found = found.union(part)
    return found.orderBy(*order).limit(limit)


def narrow_to_page(lines: DataFrame, offset: int, limit: int) -> list[DataFrame]:
    """Frames that together hold the lines of a page, each at most ``limit`` or a few lines.

    The driver sees the boundaries and a count between two of them.
    """
    wanted: list[DataFrame] = []
    todo = [(lines, offset, limit)]  # lines, how many to skip in them, how many to take
    while todo:
        part, skip, take = todo.pop(0)
        kind = part.schema["_key"].dataType
        keys = part.select("_key").orderBy(F.rand(0)).limit(BOUNDARIES).distinct().collect()
        if not keys:
            continue
        # Lines like a boundary are a part of their own, so every split gets ahead.
        place = F.lit(0)
        for r in keys:
            bound = _literal(r[0], kind)
            place = place + F.when(F.col("_key") > bound, 2).when(F.col("_key") == bound, 1).otherwise(0)
        counts = dict(
            part.groupBy(place.alias("b")).agg(F.struct(F.count("*").alias("n"), (F.min("_key") == F.max("_key")).alias("one"))).collect()
        )
        for b in sorted(counts):
            n, one = counts[b]
            if take <= 0:
                break
            if skip >= n:
                skip -= n
                continue
            here = min(take, n - skip)
            own = part.filter(place == b)
            if one:  # lines that look the same
                wanted.append(own.limit(here))
            elif n <= AT_ONCE:
                wanted.append(own.orderBy("_key").offset(skip).limit(here))
            else:
                todo.append((own, skip, here))
            take -= here
            skip = 0
    return wanted


def _literal(key, kind) -> Column:
    return F.struct(
        *(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, kind.fields, strict=True))
    )


def display_names(df: DataFrame, spec: LedgerSpec) -> DataFrame:
    """The same lines under their display names."""
    return df.withColumnsRenamed({c: spec.label(c) for c in df.columns})
