"""Every operator as a query over the benchmark tables.

Each query takes (session, folder of the tables) and covers all rows. Money is
a decimal inside and a double in the result.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions import (
    active_vat,
    export_date,
    extract_entity_id,
    format_amount,
    format_pct,
    parse_local_number,
    seller_or_missing,
    supplier_name,
    year_from_name,
    years_label,
)
from spendlens.operators import (
    anomalies,
    changes,
    comparison,
    corrections,
    drilldown,
    enrich,
    explorer,
    filters,
    option_index,
    preview,
    totals,
    yoy,
)
from spendlens.operators.filters import AnomalySelection, Selection, keep_lines, match_all
from spendlens.plans import analysis_view
from spendlens.session import scratch_path, shuffles_removed, stored_once
from spendlens.sources import calendar, catalog, chunks, csv, ledger, sinks
from spendlens.sources.star import city_ledger, state_ledger
from spendlens.spec import CITY, STATE, LedgerSpec
from spendlens.streaming import (
    follow_months,
    land_delivery,
    read_comparison,
    refresh,
    update_comparison,
)
from spendlens.streaming.deliveries import read_refreshed

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the queries; oracle.py states the same values in SQL.
YEAR = 1998
TYPE = "ECONOMY"
BUYER = "ASIA"
SELLER = "NATION_3"
CITY_SELLER = "VAT NATION_6"
CITY_PLAIN_SELLER = "VAT NATION_10"
PAIRS = {"threshold": 50_000, "tolerance": 1_000}
FLAGS = {"min_pct": 20.0, "min_amount": 500_000}
PICK = Selection(year=YEAR, type=TYPE, buyer=BUYER)
UP = AnomalySelection(year=YEAR, direction="up", min_change_pct=50)
REFRESH_SPLIT = dt.date(1999, 6, 15)
REFRESH_MONTH = dt.date(1999, 6, 1)
YOY_MONTHS = (dt.date(1997, 12, 1), dt.date(1998, 2, 28))

_QUERIES: dict[str, Query] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Money as doubles, at the very end."""
    return df.select(
        *(
            F.col(f"`{f.name}`").cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        )
    )


def named(name: str) -> Callable[[Query], Query]:
    """Register a query under a name."""

    def register(fn: Query) -> Query:
        _QUERIES[name] = lambda spark, sf_dir: _plain(fn(spark, sf_dir))
        return fn

    return register


def query(fn: Query) -> Query:
    return named(fn.__name__)(fn)


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


class Source:
    """One kind of ledger over the benchmark tables."""

    def __init__(self, spec: LedgerSpec, build, suffix: str):
        self.spec, self.build, self.suffix = spec, build, suffix

    def lines(self, spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
        """The ledger, of which only ``columns`` are needed (all if none)."""
        if not columns:
            return self.build(spark, sf_dir)
        base = {"year", "amount", "is_correction"} | ({"paid_on"} if self.spec.date else set())
        return self.build(spark, sf_dir, base | set(columns))

    def yoy(self, spark: SparkSession, sf_dir: str, *only: int) -> DataFrame:
        lines = self.lines(spark, sf_dir, *self.spec.grain)
        return yoy.year_over_year(lines, self.spec, only or None)


S = Source(STATE, state_ledger, "")
C = Source(CITY, city_ledger, "_city")
SUPPLIER = ("vat_name", "company", "vat_no")


def both(fn: Callable[[SparkSession, str, Source], DataFrame]):
    """Register a query for the state ledger and, as ``*_city``, for the city."""
    for src in (S, C):
        def run(spark, sf_dir, src=src):
            return _plain(fn(spark, sf_dir, src))
        _QUERIES[fn.__name__ + src.suffix] = run
    return fn


def per(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


# --- scans, sources, sinks ---------------------------------------------------


@query
def scan_ledger(spark, sf_dir):
    ledger.open_table(spark, f"{sf_dir}/lineitem.parquet", view="payment_lines")
    return spark.sql(
        "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, "
        "sum(cast(l_extendedprice AS decimal(18,2))) AS total "
        "FROM payment_lines GROUP BY l_returnflag, l_linestatus"
    )


def _file_names(df: DataFrame, spec: LedgerSpec) -> DataFrame:
    """Canonical names back to those of the published files."""
    back: dict[str, str] = {}
    for published, name in spec.file_names.items():
        back.setdefault(name, published)
    return df.withColumnsRenamed({n: back[n] for n in df.columns if n in back})


@query
def scan_with_year(spark, sf_dir):
    path = scratch_path(spark, "state")
    lines = state_ledger(spark, sf_dir).drop("year")
    sinks.write_table(_file_names(lines, STATE), path)
    stored = ledger.open_ledger(spark, path, STATE, view="state_lines")
    return per(stored, "year", "buyer")


@query
def sink_by_year(spark, sf_dir):
    path = scratch_path(spark, "state-by-year")
    sinks.write_by_year(S.lines(spark, sf_dir, "type"), path, STATE)
    stored = ledger.open_ledger(spark, path, STATE)
    return per(stored.filter(filters.year_is(STATE, YEAR)), "type", "paid_on")


@query
def sink_yoy(spark, sf_dir):
    path = scratch_path(spark, "yoy")
    sinks.write_yoy(S.yoy(spark, sf_dir), path, STATE)
    return ledger.open_yoy(spark, path, STATE).select(
        "year", *STATE.grain, "actual_real", "prior_real", "yoy_real_change", "yoy_real_pct"
    )


@query
def combine_chunks(spark, sf_dir):
    landed, out = scratch_path(spark, "chunks"), scratch_path(spark, "combined")
    lines = S.lines(spark, sf_dir, "type").drop("year")
    sinks.write_by_month(lines, landed)
    return per(chunks.combine_chunks(spark, [landed], out), F.trunc("paid_on", "month").alias("month"), "type")


@query
def combine_chunks_city(spark, sf_dir):
    """A ledger stored by year next to one whose types were guessed."""
    landed, drifted, out = (scratch_path(spark, n) for n in ("chunks", "drifted", "combined"))
    lines = C.lines(spark, sf_dir, "org0", "type1").drop("is_correction")
    sinks.write_by_year(lines.filter("year < 1999"), landed, CITY)
    later = lines.filter("year >= 1999").withColumn("amount", F.col("amount").cast("double"))
    sinks.write_table(later, drifted)
    return per(chunks.combine_chunks(spark, [landed, drifted], out, CITY), "year", "org0", "type1")


@query
def export_ingest(spark, sf_dir):
    """Comma-separated exports, read back with explicit types."""
    landed = scratch_path(spark, "exports")
    lines = S.lines(spark, sf_dir, "buyer", "type").drop("year", "is_correction")
    lines = lines.withColumn("type", F.concat("type", F.lit(HARD.format(","))))
    _file_names(lines, STATE).write.options(header=True, escape='"').csv(landed)
    return per(chunks.ingest_export(spark, landed), "paid_on", "buyer", "type")


# Ends names with quotes, a separator, a backslash and a line break.
HARD = '"x"{} "\\\ny'


def _land_city_csv(
    spark: SparkSession, sf_dir: str, drop: tuple[str, ...], even_years_only: bool = False
) -> list[str]:
    """Yearly CSV folders as a city publishes them.

    The columns in ``drop`` are missing, in all years or in the even ones: a
    missing year must come from the name, other columns from the other years.
    """
    landed = scratch_path(spark, "annual")
    lines = city_ledger(spark, sf_dir).drop("is_correction")
    local = F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(","))
    lines = lines.withColumn("org1", F.concat("org1", F.lit(HARD.format(";"))))
    named = _file_names(lines.withColumn("amount", local), CITY).withColumn("annual", F.col("ar"))
    even = F.coalesce(F.col("annual") % 2 == 0, F.lit(False))
    # The join of the tables is shuffled for half the years at a time.
    parts = [named.filter(~even).drop(*(() if even_years_only else drop)), named.filter(even).drop(*drop)]
    for part in parts:
        with shuffles_removed(spark):
            part.write.mode("append").partitionBy("annual").options(
                header=True, sep=";", escape='"', compression="gzip"
            ).csv(landed)
    found = [r[0] for r in city_ledger(spark, sf_dir, ["year"]).distinct().collect()]
    return [f"{landed}/annual={y}" for y in sorted(found)]


@query
def csv_ingest(spark, sf_dir):
    lines = csv.combine_years(spark, _land_city_csv(spark, sf_dir, ("ar",)))
    return per(
        lines, "year", "org0", "org1", "org2", "type0", "type1",
        supplier_name().alias("supplier_name"), "is_correction",
    )


@query
def union_years(spark, sf_dir):
    paths = _land_city_csv(spark, sf_dir, ("ar", "tgr1", "xtgr1"), even_years_only=True)
    return csv.combine_years(spark, paths).groupBy("year").agg(
        F.count("*").alias("n"),
        F.count("expense_code").alias("with_code"),
        F.count("expense_label").alias("with_label"),
        F.sum("amount").alias("total"),
    )


@query
def normalize_columns(spark, sf_dir):
    lines = C.lines(spark, sf_dir, "org2", "type0")
    published = lines.select(
        F.col("year").alias(" ÁR "),
        F.col("amount").alias("Raun"),
        F.col("org2").alias("SAMTALA2"),
        F.col("type0").alias(" Tegund0"),
    )
    return per(csv.merge_columns(published), "year", "org2", "type0")


@query
def anomaly_source(spark, sf_dir):
    base = scratch_path(spark, "anomalies")
    sinks.write_yoy(S.yoy(spark, sf_dir), f"{base}/all", STATE)
    found = ledger.anomaly_source(spark, f"{base}/flagged", f"{base}/all", STATE)
    column = ledger.resolve_column(found, "org0", STATE.buyers)
    return found.groupBy(F.col(column).alias("grp"), "year").agg(
        F.count("*").alias("n"), F.sum("actual_real").alias("actual_real")
    )


@query
def high_water_mark(spark, sf_dir):
    return calendar.high_water_mark(state_ledger(spark, sf_dir, ["paid_on"]))


@query
def month_chunks(spark, sf_dir):
    days = state_ledger(spark, sf_dir, ["paid_on"]).agg(
        F.min("paid_on").alias("first_day"), F.max("paid_on").alias("last_day")
    )
    return calendar.month_chunks(days, F.date_add("first_day", 14), "last_day")


@query
def incremental_refresh(spark, sf_dir):
    """Two deliveries; the second repeats, and completes, the last month."""
    landing, target = scratch_path(spark, "landing"), scratch_path(spark, "refreshed")
    checkpoint = scratch_path(spark, "refresh")
    lines = state_ledger(spark, sf_dir).drop("year")
    land_delivery(lines.filter(F.col("paid_on") <= F.lit(REFRESH_SPLIT)), landing, 1)
    refresh(spark, landing, target, checkpoint)
    land_delivery(lines.filter(F.col("paid_on") >= F.lit(REFRESH_MONTH)), landing, 2)
    refresh(spark, landing, target, checkpoint)
    return per(
        read_refreshed(spark, target), F.trunc("paid_on", "month").alias("month"), "buyer", "type"
    )


@query
def incremental_yoy(spark, sf_dir):
    """The comparison after two deliveries; the second touches months on both sides of a year."""
    landing, target, checkpoint, base = (
        scratch_path(spark, n) for n in ("landing", "refreshed", "refresh", "follow")
    )

    def follow(session, months):
        follow_months(session, target, base, months, STATE)

    lines = state_ledger(spark, sf_dir).drop("year")
    half = lines.filter(F.col("paid_on").between(*YOY_MONTHS) & (F.col("amount") > 0))
    rest = lines.filter(~F.col("paid_on").between(*YOY_MONTHS) | F.col("paid_on").isNull())
    land_delivery(rest.unionByName(half), landing, 1)
    refresh(spark, landing, target, checkpoint, on_change=follow)
    land_delivery(lines.filter(F.col("paid_on").between(*YOY_MONTHS)), landing, 2)
    refresh(spark, landing, target, checkpoint, on_change=follow)
    return read_comparison(spark, base, STATE)


@query
def incremental_yoy_city(spark, sf_dir):
    """The comparison after one year of a city's ledger has been delivered anew."""
    base = scratch_path(spark, "follow-city")
    lines = C.lines(spark, sf_dir, *CITY.grain)
    # Joined once, half of the years at a time.
    even = F.coalesce(F.col("year") % 2 == 0, F.lit(False))
    halves = [stored_once(lines.filter(half), "city-lines") for half in (even, ~even)]
    lines = halves[0].unionByName(halves[1])
    update_comparison(lines.filter((F.col("year") != YEAR) | (F.col("amount") > 0)), base, CITY)
    update_comparison(lines.filter(F.col("year") == YEAR), base, CITY)
    return read_comparison(spark, base, CITY)


def _catalog_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalog answer per page, with resources of several formats."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    year = (F.col("page_id") % 9 + 2014).cast("string")

    def resource(fmt: str, url: Column, name: Column) -> Column:
        return F.struct(F.lit(fmt).alias("format"), url.alias("url"), name.alias("name"))

    answer = F.struct(
        F.lit(True).alias("success"),
        F.struct(
            F.array(
                resource("csv", F.col("url"), F.concat(F.lit("annual_"), year)),
                resource("XLSX", F.col("url"), F.concat(F.lit("annual_"), year)),
                resource("CSV", F.when(F.col("page_id") % 4 != 0, F.concat("url", F.lit("/x"))),
                         F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("extra-"), year))),
            ).alias("resources")
        ).alias("result"),
    )
    return pages.select(F.to_json(answer).alias("answer"))


@query
def catalog_resources(spark, sf_dir):
    return catalog.catalog_resources(_catalog_answers(spark, sf_dir), "answer")


@query
def catalog_resources_years(spark, sf_dir):
    found = catalog.catalog_resources(_catalog_answers(spark, sf_dir), "answer")
    return catalog.with_year_in_name(found, [2015, 2019])


# --- filters -----------------------------------------------------------------


@query
def explore_filter(spark, sf_dir):
    lines = S.lines(spark, sf_dir, "type", "buyer", "seller")
    return per(lines.filter(PICK.predicate(STATE)), "seller", "paid_on")


@query
def explore_filter_unit(spark, sf_dir):
    lines = C.lines(spark, sf_dir, "type0", "org0", "org1")
    where = Selection(type=TYPE, unit="NATION_6").predicate(CITY)
    return per(lines.filter(where), "year", "org0")


@both
def exclude_corrections(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, src.spec.type)
    return per(lines.filter(keep_lines(src.spec)), "year", F.col(src.spec.type).alias("grp"))


@query
def sign_filter(spark, sf_dir):
    lines = C.lines(spark, sf_dir, "org1")
    return per(lines.filter(filters.sign_is(CITY, "neg")), "year", "org1")


@query
def supplier_filter(spark, sf_dir):
    lines = C.lines(spark, sf_dir, *SUPPLIER)
    return per(lines.filter(filters.seller_is(CITY, CITY_SELLER)), "year")


@both
def anomaly_filter(spark, sf_dir, src):
    return src.yoy(spark, sf_dir, YEAR).filter(UP.predicate())


@both
def flag_anomalies(spark, sf_dir, src):
    return yoy.flag_anomalies(src.yoy(spark, sf_dir), **FLAGS)


@both
def focus_options(spark, sf_dir, src):
    options = filters.options(src.yoy(spark, sf_dir), src.spec.type)
    return options.select(F.col(src.spec.type).alias("value"))


@query
def option_search(spark, sf_dir):
    return filters.search_options(S.lines(spark, sf_dir, "seller"), "seller", "  nation_1 ")


@query
def option_search_city(spark, sf_dir):
    return filters.search_options(C.lines(spark, sf_dir, "org3"), "org3", " 12 ")


@query
def option_search_index(spark, sf_dir):
    """A search in an index of two columns, one of which was extended by later lines."""
    path = scratch_path(spark, "options")
    lines = S.lines(spark, sf_dir, "seller", "type")
    early = filters.year_is(STATE, YEAR)
    option_index.write_option_index(lines.filter(early), ["seller", "type"], path)
    option_index.extend_option_index(lines, ["seller", "type"], path)
    return option_index.search_index(spark, path, "seller", "  nation_1 ")


@query
def option_search_index_city(spark, sf_dir):
    """A text shorter than the grams of the index."""
    path = scratch_path(spark, "options")
    option_index.write_option_index(C.lines(spark, sf_dir, "org3"), ["org3"], path)
    return option_index.search_index(spark, path, "org3", " 12 ")


@both
def preview_page(spark, sf_dir, src):
    columns = SUPPLIER if src is C else ()
    lines = src.lines(spark, sf_dir, *columns, *(set(src.spec.preview) - {"supplier_name"}))
    return preview.preview_page(lines, src.spec, keep_lines(src.spec), page=3, limit=50)


@both
def preview_far_page(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, *src.spec.analysis_preview)
    return preview.preview_page(
        lines, src.spec, F.lit(True), page=41, limit=500, columns=src.spec.analysis_preview
    )


@query
def preview_display_names(spark, sf_dir):
    lines = S.lines(spark, sf_dir, *STATE.preview)
    page = preview.preview_page(lines, STATE, PICK.predicate(STATE), page=1, limit=500)
    return preview.display_names(page, STATE)


@both
def page_count(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, src.spec.type)
    return totals.page_count(lines, keep_lines(src.spec), 50)


# --- corrections -------------------------------------------------------------


@query
def correction_pairs_window(spark, sf_dir):
    return corrections.corrected_invoices(state_ledger(spark, sf_dir), STATE, **PAIRS)


@query
def correction_pairs_symmetric(spark, sf_dir):
    return corrections.corrected_invoices(
        state_ledger(spark, sf_dir), STATE, symmetric=True, **PAIRS
    )


@query
def correction_pairs_nullsafe(spark, sf_dir):
    return corrections.corrected_lines(city_ledger(spark, sf_dir), CITY, **PAIRS)


@query
def flag_corrections_invoice(spark, sf_dir):
    return corrections.flag_state_corrections(state_ledger(spark, sf_dir), STATE, **PAIRS)


@query
def flag_corrections_row(spark, sf_dir):
    return corrections.flag_city_corrections(city_ledger(spark, sf_dir), CITY, **PAIRS)


# --- year over year ----------------------------------------------------------


@query
def yoy_state(spark, sf_dir):
    return S.yoy(spark, sf_dir)


@query
def yoy_city(spark, sf_dir):
    return C.yoy(spark, sf_dir)


@both
def report_yoy_top(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, src.spec.type)
    return comparison.two_year_change(lines, src.spec, src.spec.type)


@both
def report_yoy_top_buyer(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, src.spec.buyer)
    return comparison.two_year_change(lines, src.spec, src.spec.buyer)


def _rounded(df: DataFrame) -> DataFrame:
    """Means of doubles depend on the order of addition in the last bits."""
    return df.withColumns(
        {c: F.round(c, 6) for c in ("avg_change_pct", "diff_pct") if c in df.columns}
    )


@both
def analysis_selected_change(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, src.spec.type)
    where = match_all([(src.spec.type, TYPE)]) & keep_lines(src.spec)
    return changes.selected_change(lines, src.spec, where)


@both
def analysis_avg_change(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, src.spec.type)
    return _rounded(changes.average_change(lines, src.spec, src.spec.type))


@both
def analysis_change(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, src.spec.buyer)
    where = match_all([(src.spec.buyer, BUYER)]) & keep_lines(src.spec)
    return _rounded(changes.change_against_average(lines, src.spec, src.spec.buyer, where))


@query
def analysis_unknown_value(spark, sf_dir):
    """A value no line carries is treated as no filter."""
    lines = S.lines(spark, sf_dir, *STATE.analysis_preview)
    return _rounded(analysis_view(lines, STATE, "type", "NO SUCH TYPE")["changes"])


@both
def anomaly_score(spark, sf_dir, src):
    return anomalies.anomaly_score(
        src.yoy(spark, sf_dir, YEAR), src.spec.buyer, AnomalySelection(year=YEAR).predicate(), 20
    )


@both
def anomaly_detail(spark, sf_dir, src):
    where = AnomalySelection(direction="down").predicate() & match_all([(src.spec.type, TYPE)])
    return anomalies.anomaly_detail(src.yoy(spark, sf_dir), src.spec.buyer, where, 50)


@both
def anomaly_context(spark, sf_dir, src):
    spec = src.spec
    flagged = yoy.flag_anomalies(src.yoy(spark, sf_dir), **FLAGS)
    return anomalies.anomaly_context(
        src.lines(spark, sf_dir, spec.type, spec.buyer), flagged, spec, spec.focus("type"),
        TYPE, AnomalySelection(direction="up").predicate(), within=BUYER,
    )


@both
def anomaly_year_series(spark, sf_dir, src):
    spec = src.spec
    flagged = yoy.flag_anomalies(src.yoy(spark, sf_dir), **FLAGS)
    return anomalies.anomaly_year_series(
        src.lines(spark, sf_dir, spec.type, spec.buyer), flagged, spec,
        AnomalySelection(direction="up", min_change_pct=50).predicate(with_year=False),
        [(spec.type, TYPE), (spec.buyer, BUYER)],
    )


# --- totals ------------------------------------------------------------------


@both
def headline_yearly(spark, sf_dir, src):
    return totals.headline_yearly(src.lines(spark, sf_dir, "amount"), src.spec)


@both
def headline_latest(spark, sf_dir, src):
    latest = totals.headline_latest(src.lines(spark, sf_dir, "amount"), src.spec)
    return latest.select("year", "net", format_amount(F.col("net")).alias("shown"))


@both
def explore_yearly(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, src.spec.type, src.spec.buyer)
    return totals.yearly_total(lines, src.spec, PICK.predicate(src.spec, with_year=False))


@both
def breakdown_type(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, src.spec.type)
    return totals.breakdown(
        lines, src.spec, src.spec.type, keep_lines(src.spec), missing=src.spec.type_fallback
    )


@both
def breakdown_buyer(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, src.spec.buyer)
    return totals.breakdown(lines, src.spec, src.spec.buyer, Selection(year=YEAR).predicate(src.spec))


@both
def breakdown_seller(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, *(SUPPLIER if src is C else ("seller",)))
    return totals.breakdown(lines, src.spec, src.spec.seller, keep_lines(src.spec), top=10)


@both
def breakdowns(spark, sf_dir, src):
    spec = src.spec
    lines = src.lines(spark, sf_dir, spec.type, spec.buyer, *(SUPPLIER if src is C else ("seller",)))
    sections = {"type": spec.type, "buyer": spec.buyer, "seller": spec.seller}
    return totals.breakdowns(lines, spec, sections, keep_lines(spec), top=10)


@both
def explorer_page(spark, sf_dir, src):
    """All lists and totals of a page from one scan."""
    spec = src.spec
    names = (*SUPPLIER, spec.buyers[1]) if src is C else ("seller",)
    lines = src.lines(spark, sf_dir, spec.type, spec.buyer, *names)
    return explorer.explorer_sections(lines, spec, Selection(year=YEAR, type=TYPE, sign="pos"))


@both
def explore_totals(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, src.spec.type, src.spec.buyer)
    return totals.overall(lines, src.spec, PICK.predicate(src.spec))


@both
def explore_totals_empty(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, src.spec.type)
    return totals.overall(lines, src.spec, Selection(type="NO SUCH TYPE").predicate(src.spec))


@both
def report_top_groups(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, src.spec.buyer)
    where = keep_lines(src.spec) & filters.year_is(src.spec, f"{YEAR}*")
    return totals.top_groups(lines, src.spec, src.spec.buyer, where)


@both
def report_yearly(spark, sf_dir, src):
    return totals.yearly_total(src.lines(spark, sf_dir, "amount"), src.spec)


@both
def drill_types_l0(spark, sf_dir, src):
    return drilldown.drill_types(src.lines(spark, sf_dir, src.spec.type), src.spec, YEAR)


@both
def drill_types_l1(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, src.spec.type, src.spec.buyer)
    return drilldown.drill_type_buyers(lines, src.spec, TYPE)


@both
def drill_sellers_l0(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, *(SUPPLIER if src is C else ("seller",)))
    return drilldown.drill_sellers(lines, src.spec)


@query
def drill_sellers_l1(spark, sf_dir):
    lines = S.lines(spark, sf_dir, "buyer", "seller")
    return drilldown.drill_seller_buyers(lines, STATE, SELLER, YEAR)


@query
def drill_bad_year(spark, sf_dir):
    return drilldown.drill_types(S.lines(spark, sf_dir, "type"), STATE, "19x8")


def _adaptive(spark, sf_dir, seller):
    lines = C.lines(spark, sf_dir, *SUPPLIER, "org0", "expense_code", "expense_label")
    return drilldown.drill_seller_adaptive(lines, CITY, seller)


@query
def drill_sellers_adaptive(spark, sf_dir):
    return _adaptive(spark, sf_dir, CITY_SELLER)


@query
def drill_sellers_adaptive_units(spark, sf_dir):
    return _adaptive(spark, sf_dir, CITY_PLAIN_SELLER)


@both
def options_distinct(spark, sf_dir, src):
    lines = src.lines(spark, sf_dir, src.spec.type)
    return filters.options(lines, src.spec.type).select(F.col(src.spec.type).alias("value"))


@both
def years_distinct(spark, sf_dir, src):
    found = filters.years(src.lines(spark, sf_dir, "year"), src.spec)
    return found.withColumn("label", years_label())


# --- suppliers ---------------------------------------------------------------


@query
def vat_lookup(spark, sf_dir):
    return enrich.vat_lookup(city_ledger(spark, sf_dir, SUPPLIER))


@query
def vat_coverage(spark, sf_dir):
    return enrich.vat_coverage(city_ledger(spark, sf_dir, SUPPLIER))


@query
def vat_template(spark, sf_dir):
    return enrich.seller_template(state_ledger(spark, sf_dir, ["seller"]), STATE)


@query
def vat_template_coverage(spark, sf_dir):
    return enrich.lookup_coverage(enrich.seller_template(state_ledger(spark, sf_dir, ["seller"]), STATE))


def _sellers(spark, sf_dir):
    return enrich.all_sellers(
        state_ledger(spark, sf_dir, ["seller"]),
        city_ledger(spark, sf_dir, [*SUPPLIER, "company_label"]),
        STATE,
    )


@query
def sellers_union(spark, sf_dir):
    return _sellers(spark, sf_dir)


def _entry(number: Column, ended: Column) -> Column:
    """A registry entry; ``ended`` is JSON."""
    return F.format_string('{"vatNumber":"%d","deRegistered":%s}', number, ended)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry answers about suppliers: none, one or two VAT entries."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key, over = F.col("s_suppkey"), F.col("s_acctbal") < 0
    # What is not a date says in four ways that a number is registered.
    open_ = F.element_at(F.array(*map(F.lit, ("null", "false", "0", '""'))), (key % 4 + 1).cast("int"))
    first = _entry(key * 10 + 1, F.when(over, '"2020-01-31"').otherwise(open_))
    second = _entry(key * 10 + 2, F.when(key % 3 == 0, '"2021-06-30"').otherwise(open_))
    entries = (
        F.when(key % 5 == 0, F.lit(""))
        .when(key % 5 == 1, F.concat(F.lit('{"note":"none"},'), first))
        .when(key % 5 == 2, first)
        .otherwise(F.concat_ws(",", first, second))
    )
    return supplier.select(
        key,
        F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("name"),
        F.format_string("%010d", F.col("s_nationkey")).alias("entity"),
        F.concat(F.lit('{"vat":['), entries, F.lit("]}")).alias("answer"),
    )


@named("active_vat")
def active_vat_number(spark, sf_dir):
    return _answers(spark, sf_dir).select("s_suppkey", active_vat(F.col("answer")).alias("vat"))


@query
def vat_enrich(spark, sf_dir):
    """Names to ids by stored search pages, ids to numbers by stored answers."""
    stored = _answers(spark, sf_dir)
    pages = stored.select(
        "name", F.format_string("<a href='/kennitala/%s'>%s</a>", "entity", "name").alias("page")
    )
    ids = enrich.registry_ids(pages, "name", "page")
    return enrich.enrich_sellers(
        _sellers(spark, sf_dir), enrich.numbers_by_id(ids, stored, "entity", "answer")
    )


@named("extract_entity_id")
def entity_id(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", extract_entity_id(F.col("html")).alias("entity"))


# --- scalar functions --------------------------------------------------------


@named("parse_local_number")
def local_number(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    whole = F.col("l_extendedprice").cast("decimal(18,2)")
    shown = F.translate(F.format_number(whole, 2), ",.", ".,")
    text = (
        F.when(F.col("l_linenumber") == 1, F.lit("  "))
        .when(F.col("l_linenumber") == 2, F.lit("n/a"))
        .when(F.col("l_linenumber") == 3, F.concat(F.lit("\t-"), shown, F.lit(" ")))
        .otherwise(shown)
    )
    number = parse_local_number(text)
    return lines.groupBy("l_linenumber").agg(
        F.count("*").alias("n"),
        F.count(number).alias("parsed"),
        F.sum(number.cast("decimal(18,2)")).alias("total"),
    )


@named("format_amount")
def amount_text(spark, sf_dir):
    lines = S.lines(spark, sf_dir, "seller")
    rows = lines.groupBy("seller", "year").agg(F.sum("amount").alias("total"))
    return rows.select("seller", "year", format_amount(F.col("total")).alias("shown"))


@named("format_pct")
def pct_text(spark, sf_dir):
    return S.yoy(spark, sf_dir).select(
        "year", *STATE.grain, format_pct(F.col("yoy_real_pct")).alias("shown")
    )


@named("supplier_name")
def supplier_names(spark, sf_dir):
    lines = C.lines(spark, sf_dir, *SUPPLIER)
    return per(lines, supplier_name().alias("supplier_name"))


@query
def missing_label(spark, sf_dir):
    lines = C.lines(spark, sf_dir, "company")
    return per(lines, seller_or_missing(F.col("company")).alias("seller_name"))


@named("year_from_name")
def name_year(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", year_from_name(F.col("html")).alias("year"))


@query
def export_dates(spark, sf_dir):
    lines = state_ledger(spark, sf_dir, ["paid_on"])
    return lines.groupBy(export_date(F.col("paid_on")).alias("day")).agg(F.count("*").alias("n"))
