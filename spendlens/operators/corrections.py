"""Marking payment lines that a counter-entry cancels out.

A line is a correction when a partner exists with the same keys, the opposite
sign and nearly the same size. Only existence matters, so no pair is ever
built:

1. Large enough lines are summarised per *cell* = keys, day, sign and size
   bucket as wide as the tolerance, keeping the smallest and the largest size.
   Map-side aggregation makes a hot cell one row per task.
2. Each cell is copied to its own and the neighbouring buckets, where a window
   over the days in reach tells what cells of the opposite sign hold. In the
   same bucket any partner is near enough; from the bucket below only its
   largest size and from the bucket above only its smallest can be the nearest.
   Cells that hear nothing near are dropped.
3. A line looks up the one row of its own cell.

The work is linear in the lines. After step 2 few cells are left, and Spark
broadcasts them if their size allows; otherwise the lines are shuffled by cell
and AQE splits a hot cell over several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored_once
from ..spec import AMOUNT_TYPE, LedgerSpec

THRESHOLD = 1e9
TOLERANCE = 1000
WINDOW_DAYS = 2
#: Parts over which the lines of one invoice are dealt.
SALTS = 16


def _cents(value: float) -> int:
    """Whole cents below a limit: amounts hold cents, so none lies between."""
    return int((Decimal(str(value)) * 100).to_integral_value(ROUND_FLOOR))


def _width(tolerance: float) -> int:
    """Cents that a difference below ``tolerance`` is less than."""
    if tolerance <= 0:
        raise ValueError("the tolerance must be above 0")
    return int((Decimal(str(tolerance)) * 100).to_integral_value(ROUND_CEILING))


def larger_than(amount: Column, limit: float) -> Column:
    """``|amount| > limit`` in a form the Parquet scan can skip by."""
    bound = F.lit(Decimal(_cents(limit)) / 100).cast(AMOUNT_TYPE)
    return (amount > bound) | (amount < -bound)


def with_cell(df: DataFrame, spec: LedgerSpec, tolerance: float) -> DataFrame:
    """Sign, size in cents and size bucket; integer division is exact."""
    amount = F.col(spec.amount).cast(AMOUNT_TYPE)
    return (
        df.withColumn("_up", amount > 0)
        .withColumn("_size", (F.abs(amount) * 100).cast("bigint"))
        .withColumn("_bucket", F.expr(f"_size div {_width(tolerance)}L"))
    )


def _near(least: Column, most: Column, tolerance: float) -> Column:
    """Whether sizes from ``least`` to ``most`` in one cell meet a partner."""
    tol = F.lit(_width(tolerance))
    return (
        F.coalesce("_here", F.lit(False))
        | F.coalesce(least - F.col("_below") < tol, F.lit(False))
        | F.coalesce(F.col("_above") - most < tol, F.lit(False))
    )


def matched_cells(
    lines: DataFrame,
    keys: Sequence[str],
    day: str | None,
    offsets: Sequence[int],
    is_probe: Column,
    is_partner: Column,
    tolerance: float,
) -> DataFrame:
    """Cells with a probe near a partner, and what they heard: a partner in
    the same bucket, the largest one below, the smallest one above.

    A partner on day ``d`` is heard on the days ``d + offset``.
    """
    cell = [*keys, *([day] if day else []), "_up", "_bucket"]
    size = F.col("_size")
    cells = lines.groupBy(*cell).agg(
        F.min(F.when(is_probe, size)).alias("_least"),
        F.max(F.when(is_probe, size)).alias("_most"),
        F.min(F.when(is_partner, size)).alias("_lo"),
        F.max(F.when(is_partner, size)).alias("_hi"),
    )
    # Each cell stands in its own bucket and in both neighbouring ones, whatever the days.
    low, high, silent = F.col("_lo"), F.col("_hi"), F.lit(None).cast("bigint")

    def copy(step: int, least: Column, most: Column, here: Column, below: Column, above: Column) -> Column:
        return F.struct(
            (F.col("_bucket") + F.lit(step)).alias("_bucket"), F.lit(step == 0).alias("_own"),
            least.alias("_least"), most.alias("_most"),
            here.alias("_at"), below.alias("_under"), above.alias("_over"),
        )

    copies = F.array(
        copy(0, F.col("_least"), F.col("_most"), low.isNotNull(), silent, silent),
        copy(1, silent, silent, F.lit(False), high, silent),
        copy(-1, silent, silent, F.lit(False), silent, low),
    )
    near = Window.partitionBy(*keys, "_bucket")
    if day:
        # A partner on day d is heard on d + offset, so the days d - offset are heard on d.
        near = near.orderBy(F.unix_date(day)).rangeBetween(-max(offsets), -min(offsets))

    def opposite(what, column: str) -> Column:
        up, value = F.col("_up"), F.col(column)
        told = [what(F.when(side, value)).over(near) for side in (~up, up)]
        return F.when(up, told[0]).otherwise(told[1])

    return (
        cells.select(*keys, *([day] if day else []), "_up", F.inline(copies))
        .withColumns({
            "_here": F.coalesce(opposite(F.max, "_at"), F.lit(False)),
            "_below": opposite(F.max, "_under"),
            "_above": opposite(F.min, "_over"),
        })
        .filter(F.col("_own") & F.col("_least").isNotNull())
        .filter(_near(F.col("_least"), F.col("_most"), tolerance))
        .select(*cell, "_here", "_below", "_above")
    )


def with_partner(
    probes: DataFrame,
    cells: DataFrame,
    keys: Sequence[str],
    null_safe: Sequence[str],
    day: str | None,
    tolerance: float,
    how: str = "inner",
) -> DataFrame:
    """Probes with the column ``_matched``; a probe stands for the sizes from
    ``_least`` to ``_most`` in its cell. ``how`` is ``inner`` (matched probes
    only) or ``left``."""
    exact = [*keys, *([day] if day else []), "_up", "_bucket"]
    same = F.lit(True)
    for k in exact:
        same &= probes[k] == cells[k]
    for k in null_safe:
        same &= probes[k].eqNullSafe(cells[k])
    heard = [cells[c] for c in ("_here", "_below", "_above")]
    joined = probes.join(cells, same, how).select(*(probes[c] for c in probes.columns), *heard)
    near = _near(F.col("_least"), F.col("_most"), tolerance)
    result = joined.select(*probes.columns, near.alias("_matched"))
    return result.filter("_matched") if how == "inner" else result


def possible_lines(df: DataFrame, spec: LedgerSpec, threshold: float, tolerance: float) -> DataFrame:
    """Lines that can be part of a pair: large, or near something large."""
    amount = F.col(spec.amount)
    floor = threshold - tolerance
    return df.filter(larger_than(amount, floor) if floor >= 0 else amount.isNotNull())


def corrected_invoices(
    df: DataFrame,
    spec: LedgerSpec,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    window_days: int = WINDOW_DAYS,
    symmetric: bool = False,
    keys: Sequence[str] = ("buyer", "seller", "type"),
    invoice: str = "invoice",
) -> DataFrame:
    """Invoices with a line that a later line cancels within the window.

    Keys and date must be known. By default only the earlier line counts (on
    one day both do); ``symmetric`` adds invoices of the later one. Then the
    possible lines are read four times, so a narrow copy of them is stored,
    with the keys as hashes, and the invoices of the earlier lines as well.
    """
    day = spec.date
    known = F.col(day).isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    lines = df.filter(known).select(*keys, F.col(day).cast("date").alias(day), spec.amount, invoice)
    lines = possible_lines(lines, spec, threshold, tolerance)
    if symmetric:
        narrow = with_key(lines, keys).select("_key1", "_key2", day, spec.amount, invoice)
        lines, keys = stored_once(narrow, "possible-lines"), ("_key1", "_key2")
    lines = with_cell(lines, spec, tolerance)
    large = F.col("_size") > F.lit(_cents(threshold))

    def hits(probe: Column, partner: Column, offsets: Sequence[int]) -> DataFrame:
        cells = matched_cells(lines, keys, day, offsets, probe, partner, tolerance)
        per_invoice = (
            lines.filter(probe & F.col(invoice).isNotNull())
            .withColumns({"_least": F.col("_size"), "_most": F.col("_size")})
            .select(*keys, day, "_up", "_bucket", "_least", "_most", invoice)
        )
        return with_partner(per_invoice, cells, keys, (), day, tolerance).select(invoice)

    ahead = range(window_days + 1)
    found = hits(large, F.lit(True), [-d for d in ahead])
    if symmetric:
        found = stored_once(found.distinct(), "earlier-invoices")
        found = found.union(hits(F.lit(True), large, list(ahead)))
    return found.distinct()


def flag_by_invoice(
    df: DataFrame, spec: LedgerSpec, hits: DataFrame, invoice: str = "invoice"
) -> DataFrame:
    """All lines of a hit invoice become corrections, all others do not.

    ``hits`` holds every invoice once, so the join repeats no line. Lines
    without an invoice pass by the join. A placeholder invoice may stand on
    very many lines: lines are dealt over ``SALTS`` parts of their invoice, and
    each of the few marks stands in every part.
    """
    columns = [c for c in df.columns if c != spec.flag]
    lines = df.select(*columns)
    marks = hits.select(
        F.col(invoice).alias("_hit"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part")
    )
    # The part depends on the line alone, so a task that runs again deals alike.
    part = F.pmod(F.xxhash64(*(F.col(c) for c in columns)), F.lit(SALTS)).cast("int")
    named = lines.filter(F.col(invoice).isNotNull()).withColumn("_salt", part)
    marked = named.join(
        marks, (F.col(invoice) == F.col("_hit")) & (F.col("_salt") == F.col("_part")), "left"
    ).select(*columns, F.col("_hit").isNotNull().alias(spec.flag))
    return marked.unionByName(
        lines.filter(F.col(invoice).isNull()).withColumn(spec.flag, F.lit(False))
    )


def flag_state_corrections(df: DataFrame, spec: LedgerSpec, **options) -> DataFrame:
    return flag_by_invoice(df, spec, corrected_invoices(df, spec, **options))


CITY_KEYS = (
    "type0", "type1", "type2", "type3", "type4",
    "org0", "org1", "org2", "org3", "org4", "company",
)


def with_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys as 128 bits of hash (``_key1``, ``_key2``), where NULL equals NULL alone.

    Cells and lookups then move two numbers instead of a dozen names.
    """
    gaps = F.lit(0)
    for place, k in enumerate(keys):
        gaps = gaps + F.when(F.col(k).isNull(), 1 << place).otherwise(0)
    return df.withColumns({
        "_key1": F.xxhash64(gaps, *keys),
        "_key2": F.xxhash64(F.lit("other"), *keys, gaps),
    })


def match_city_lines(
    df: DataFrame,
    spec: LedgerSpec,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    keys: Sequence[str] = CITY_KEYS,
    how: str = "inner",
) -> DataFrame:
    """Large lines with an opposite line of the same year, units, types and
    company, where NULL equals NULL. A zero is no opposite."""
    large = F.col("_size") > F.lit(_cents(threshold))
    amount, year = F.col(spec.amount), F.col(spec.year)
    possible = possible_lines(
        df.select(spec.year, spec.amount, *keys), spec, threshold, tolerance
    ).filter((amount != 0) & year.isNotNull())
    named = (spec.year, *keys)
    key = ("_key1", "_key2")
    narrow = with_cell(with_key(possible, named).select(*key, spec.amount), spec, tolerance)
    cells = matched_cells(narrow, key, None, (), large, F.lit(True), tolerance)
    probes = with_cell(df.filter(larger_than(amount, threshold)), spec, tolerance).withColumns(
        {"_least": F.col("_size"), "_most": F.col("_size")}
    )
    return with_partner(with_key(probes, named), cells, key, (), None, tolerance, how)


def corrected_lines(df: DataFrame, spec: LedgerSpec, **options) -> DataFrame:
    return match_city_lines(df, spec, **options).select(*df.columns)


def flag_city_corrections(
    df: DataFrame,
    spec: LedgerSpec,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    keys: Sequence[str] = CITY_KEYS,
) -> DataFrame:
    """Mark the matched lines one by one.

    Lines at or below the threshold cannot match; they pass through without
    a shuffle and only the large ones are joined.
    """
    columns = [c for c in df.columns if c != spec.flag]
    lines = df.select(*columns)
    large = F.coalesce(larger_than(F.col(spec.amount), threshold), F.lit(False))
    rest = lines.filter(~large).withColumn(spec.flag, F.lit(False))
    matched = match_city_lines(lines, spec, threshold, tolerance, keys, how="left")
    return rest.unionByName(
        matched.select(*columns, F.col("_matched").alias(spec.flag))
    )
