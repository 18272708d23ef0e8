"""The pages: arguments in, named DataFrames out.

Frames are lazy. Argument checks that need the data (is this value known?)
stop at the first hit and return a single value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import years_label
from ..operators import anomalies, changes, comparison, drilldown, explorer, preview, totals
from ..operators.filters import (
    ALL,
    AnomalySelection,
    Selection,
    is_set,
    keep_lines,
    match_all,
    options,
    valid_or_all,
    year_is,
    years,
)
from ..sources.ledger import resolve_column
from ..spec import LedgerSpec

Frames = dict[str, DataFrame]


def home_view(ledger: DataFrame | None, spec: LedgerSpec) -> Frames:
    """Headline figures; empty when the ledger is absent."""
    if ledger is None:
        return {}
    return {
        "yearly": totals.headline_yearly(ledger, spec),
        "latest": totals.headline_latest(ledger, spec),
    }


def explorer_view(
    ledger: DataFrame, spec: LedgerSpec, selection: Selection, page: int = 1, limit: int = 50
) -> Frames:
    """Filters, chart, breakdowns, totals and a page of lines.

    The three breakdowns (column ``section``) are one scan, totals and number
    of pages another.
    """
    where = selection.predicate(spec)
    limit = preview.clamp_limit(limit)
    sections = {"type": spec.type, "buyer": spec.buyer, "seller": spec.seller}
    frames = {
        "years": years(ledger, spec),
        "type_options": options(ledger, spec.type),
        "buyer_options": options(ledger, spec.buyer),
        "yearly": totals.yearly_total(ledger, spec, selection.predicate(spec, with_year=False)),
        "breakdowns": totals.breakdowns(ledger, spec, sections, where),
        "totals": totals.with_pages(totals.overall(ledger, spec, where), limit),
        "preview": preview.preview_page(ledger, spec, where, page, limit),
    }
    if not spec.seller_column:
        frames["unit_options"] = options(ledger, spec.buyers[1])
    if spec.type_fallback:
        name = F.when((F.col("section") == "type") & F.col("grp").isNull(), spec.type_fallback)
        frames["breakdowns"] = frames["breakdowns"].withColumn("grp", F.coalesce(name, "grp"))
    return frames


def explorer_page(
    ledger: DataFrame, spec: LedgerSpec, selection: Selection, page: int = 1, limit: int = 50
) -> Frames:
    """``explorer_view`` in two frames: every list and total in one scan, and the lines."""
    limit = preview.clamp_limit(limit)
    return {
        "sections": explorer.explorer_sections(ledger, spec, selection),
        "preview": preview.preview_page(ledger, spec, selection.predicate(spec), page, limit),
    }


def analysis_view(
    ledger: DataFrame,
    spec: LedgerSpec,
    focus: str = "type",
    value: str = ALL,
    show_corrections: bool = False,
    page: int = 1,
    limit: int = 50,
) -> Frames:
    """A value that does not occur is treated as ``all``, before any total."""
    column, _ = spec.focus(focus)
    value = valid_or_all(ledger, column, value)
    where = match_all([(column, value)]) & keep_lines(spec, show_corrections)
    limit = preview.clamp_limit(limit)
    change = changes.change_against_average(ledger, spec, column, where, show_corrections)
    return {
        "focus_options": options(ledger, column),
        "changes": change,
        "chart": change.filter(F.col("change_pct").isNotNull()),
        "latest": change.filter(F.col("change_pct").isNotNull())
        .orderBy(F.col("year").desc())
        .limit(1),
        "pages": totals.page_count(ledger, where, limit),
        "preview": preview.preview_page(
            ledger, spec, where, page, limit, spec.analysis_preview
        ),
    }


def anomalies_view(
    ledger: DataFrame | None,
    yoy: DataFrame,
    spec: LedgerSpec,
    focus: str = "type",
    value: str = ALL,
    within: str = ALL,
    selection: AnomalySelection | None = None,
    limit: int = 50,
) -> Frames:
    """Rankings of the whole table, or one value in detail.

    The inner value must be among the ranked drivers. The yearly series marks
    anomalies of all years, whatever year is selected.
    """
    selection = selection or AnomalySelection()
    focus_col, driver = spec.focus(focus)
    roles = (spec.types, spec.buyers) if focus != "buyer" else (spec.buyers, spec.types)
    focus_col = resolve_column(yoy, focus_col, roles[0])
    driver = resolve_column(yoy, driver, roles[1])
    value = valid_or_all(yoy, focus_col, value)
    where = selection.predicate()
    limit = preview.clamp_limit(limit)
    frames = {
        "focus_options": options(yoy, focus_col),
        "years": years(yoy, spec),
    }
    pairs: list[tuple[str, object]] = []
    if value == ALL:
        frames["by_buyer"] = anomalies.anomaly_score(yoy, spec.buyer, where, 20)
        frames["by_type"] = anomalies.anomaly_score(yoy, spec.type, where, 20)
    else:
        scoped = where & match_all([(focus_col, value)])
        summary = anomalies.anomaly_score(yoy, driver, scoped, 15)
        if is_set(within) and within not in {r["grp"] for r in summary.collect()}:
            within = ALL
        pairs = [(focus_col, value), (driver, within)]
        frames["summary"] = summary
        frames["detail"] = anomalies.anomaly_detail(
            yoy, driver, where & match_all(pairs), limit
        )
        if ledger is not None:
            frames["context"] = anomalies.anomaly_context(
                ledger, yoy, spec, (focus_col, driver), value, where, selection.year, within
            )
    frames["series"] = anomalies.anomaly_year_series(
        ledger, yoy, spec, selection.predicate(with_year=False), pairs
    )
    return frames


def reports_view(
    ledger: DataFrame,
    spec: LedgerSpec,
    mode: str = "type",
    year: object = ALL,
    show_corrections: bool = False,
) -> Frames:
    """The chart and the two-year table look at all lines, corrections too."""
    group = spec.type if mode == "type" else spec.buyer
    where = year_is(spec, year) & keep_lines(spec, show_corrections)
    known_years = years(ledger, spec)
    return {
        "years": known_years.withColumn("label", years_label(spec.year)),
        "yearly": totals.yearly_total(ledger, spec),
        "top": totals.top_groups(ledger, spec, group, where),
        "yoy": comparison.two_year_change(ledger, spec, group),
    }


def types_view(ledger: DataFrame, spec: LedgerSpec, value: str = "", year: object = ALL) -> Frames:
    rows = (
        drilldown.drill_type_buyers(ledger, spec, value, year)
        if value
        else drilldown.drill_types(ledger, spec, year)
    )
    return {"years": years(ledger, spec), "rows": rows}


def sellers_view(ledger: DataFrame, spec: LedgerSpec, value: str = "", year: object = ALL) -> Frames:
    if not value:
        rows = drilldown.drill_sellers(ledger, spec, year)
    elif spec.seller_column:
        rows = drilldown.drill_seller_buyers(ledger, spec, value, year)
    else:
        rows = drilldown.drill_seller_adaptive(ledger, spec, value, year)
    return {"years": years(ledger, spec), "rows": rows}
