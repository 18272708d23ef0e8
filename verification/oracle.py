"""The registered queries in plain SQL, written from their definitions.

The text takes other ways than the Spark code: existence of a counter-entry for
corrections, subqueries for the year before, sums under conditions for the
comparison of two years.
"""

from __future__ import annotations

STATE = """
state AS (
  SELECT CASE WHEN l_orderkey % 97 <> 0 THEN r.r_name END AS buyer,
         CASE WHEN l_orderkey % 89 <> 0 THEN sn.n_name END AS seller,
         CASE WHEN l_orderkey % 83 <> 0 THEN p.p_type END AS type,
         CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)) AS amount,
         CAST(l_shipdate AS DATE) AS paid_on, CAST(l_orderkey AS VARCHAR) AS invoice,
         CASE WHEN l_tax = 0.08 THEN TRUE WHEN l_linestatus = 'O' THEN FALSE END AS is_correction,
         CAST(year(l_shipdate) AS INTEGER) AS year
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey
  LEFT JOIN region r ON cn.n_regionkey = r.r_regionkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey
  LEFT JOIN part p ON l_partkey = p_partkey
)"""

CITY = """
city AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)) AS amount,
         r.r_name AS org0, cn.n_name AS org1, nullif(c_mktsegment, 'MACHINERY') AS org2,
         c_name AS org3, nullif(o_orderpriority, '5-LOW') AS org4,
         nullif(p.p_type, 'PROMO') AS type0, nullif(p_brand, 'Brand#2') AS type1,
         CASE WHEN length(p_name) % 3 <> 0 THEN p_name END AS type2,
         CASE WHEN p_size % 4 <> 0 THEN 'Size ' || CAST(p_size AS VARCHAR) END AS type3,
         CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS type4,
         CASE WHEN s_nationkey % 5 = 0 THEN '  ' ELSE 'Company of ' || sn.n_name END AS company,
         CASE WHEN s_nationkey % 2 = 0 THEN ' Label of ' || sn.n_name || ' ' END AS company_label,
         CASE WHEN s_nationkey % 7 <> 3 THEN CAST(s_nationkey * 1000 AS BIGINT) END AS vat_no,
         CASE WHEN s_nationkey % 4 = 0 THEN '' WHEN s_nationkey % 4 <> 1 THEN ' VAT ' || sn.n_name END AS vat_name,
         CASE WHEN s_nationkey % 3 = 0 AND p_size % 10 <> 0 THEN CAST(p_size % 10 AS VARCHAR) END AS expense_code,
         CASE WHEN s_nationkey % 3 = 0 AND p_size % 10 > 4 THEN 'Expense ' || CAST(p_size % 10 AS VARCHAR) END AS expense_label,
         CASE WHEN l_tax = 0.08 THEN TRUE WHEN l_linestatus = 'O' THEN FALSE END AS is_correction
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey
  LEFT JOIN region r ON cn.n_regionkey = r.r_regionkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey
  LEFT JOIN part p ON l_partkey = p_partkey
)"""

KEEP = "(is_correction = FALSE OR is_correction IS NULL)"
SUPPLIER = (
    "COALESCE(NULLIF(TRIM(vat_name), ''), NULLIF(TRIM(company), ''), "
    "NULLIF(TRIM(CAST(vat_no AS VARCHAR)), ''))"
)
VAT_PAGE = "https://www.skatturinn.is/fyrirtaekjaskra/leit/vsk-numer/"
STATE_GRAIN = ["buyer", "seller", "type"]
CITY_GRAIN = [
    "org0", "org1", "org2", "org3", "org4", "type0", "type1", "type2", "type3", "type4",
    "company", "vat_no", "vat_name",
]
CITY_PAIR = [
    "type0", "type1", "type2", "type3", "type4", "org0", "org1", "org2", "org3", "org4", "company",
]
SUMS = "COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) AS total"
POS = "CAST(SUM(CASE WHEN amount > 0 THEN amount END) AS DOUBLE) AS pos"
NEG = "CAST(SUM(CASE WHEN amount < 0 THEN amount END) AS DOUBLE) AS neg"


def _yoy(name: str, src: str, grain: list[str]) -> str:
    """Every line counts twice, for its own year and for the next; one grouping sums both."""
    keys = ", ".join(grain)
    lines = f"FROM {src} WHERE {KEEP} AND year IS NOT NULL"
    return f"""
{name}_twice AS (
  SELECT year, {keys}, amount, TRUE AS own {lines}
  UNION ALL SELECT year + 1, {keys}, amount, FALSE {lines}
),
{name} AS (
  SELECT year, {keys}, SUM(amount) FILTER (WHERE own) AS actual_real,
         COALESCE(SUM(amount) FILTER (WHERE NOT own), 0) AS prior_real,
         actual_real - prior_real AS yoy_real_change,
         CAST(yoy_real_change AS DOUBLE) / NULLIF(CAST(ABS(prior_real) AS DOUBLE), 0) * 100 AS yoy_real_pct
  FROM {name}_twice GROUP BY year, {keys} HAVING BOOL_OR(own)
)"""


STATE_YOY = f"{STATE}, {_yoy('yoy', 'state', STATE_GRAIN)}"
CITY_YOY = f"{CITY}, {_yoy('yoy', 'city', CITY_GRAIN)}"
FLAG = "(ABS(yoy_real_change) >= 500000 OR ABS(COALESCE(yoy_real_pct, 0)) >= 20)"


def _yoy_out(grain: list[str]) -> str:
    return (
        f"year, {', '.join(grain)}, CAST(actual_real AS DOUBLE) AS actual_real, "
        "CAST(prior_real AS DOUBLE) AS prior_real, "
        "CAST(yoy_real_change AS DOUBLE) AS yoy_real_change, yoy_real_pct"
    )


def _pct(cur: str, prev: str) -> str:
    return (
        f"CASE WHEN {prev} IS NULL OR {prev} = 0 THEN NULL "
        f"ELSE CAST({cur} - {prev} AS DOUBLE) / CAST(ABS({prev}) AS DOUBLE) * 100 END"
    )


def _state(body: str) -> str:
    return f"WITH {STATE} {body}"


def _city(body: str) -> str:
    return f"WITH {CITY} {body}"


def _ledgers() -> dict[str, str]:
    """Queries that exist for both kinds of ledger."""
    out: dict[str, str] = {}
    kinds = [
        ("", STATE, STATE_YOY, "state", "type", "buyer", "seller", STATE_GRAIN, "type"),
        ("_city", CITY, CITY_YOY, "city", "type0", "org0", SUPPLIER, CITY_GRAIN, "COALESCE(type0, 'Ótilgreint')"),
    ]
    for sfx, base, with_yoy, src, typ, buyer, seller, grain, type_label in kinds:
        def put(name: str, body: str, cte: str = base, sfx: str = sfx) -> None:
            out[name + sfx] = f"WITH {cte} {body}"

        pick = f"{KEEP} AND {typ} = 'ECONOMY' AND {buyer} = 'ASIA'"
        put("exclude_corrections", f"SELECT year, {typ} AS grp, {SUMS} FROM {src} WHERE {KEEP} GROUP BY year, {typ}")
        put("flag_anomalies", f"SELECT {_yoy_out(grain)} FROM yoy WHERE {FLAG}", with_yoy)
        put("focus_options", f"SELECT DISTINCT {typ} AS value FROM yoy WHERE {typ} IS NOT NULL", with_yoy)
        put("page_count", f"SELECT COUNT(*) AS n, CAST(GREATEST(1, CEIL(COUNT(*) / 50.0)) AS BIGINT) AS pages FROM {src} WHERE {KEEP}")
        put("headline_yearly", f""", t AS (SELECT year, {POS}, {NEG}, CAST(SUM(amount) AS DOUBLE) AS net
            FROM {src} WHERE {KEEP} AND year IS NOT NULL GROUP BY year)
            SELECT year, CAST(year AS VARCHAR) || CASE WHEN year = (SELECT MAX(year) FROM t) THEN '*' ELSE '' END AS label,
            COALESCE(pos, 0) AS pos, COALESCE(neg, 0) AS neg, COALESCE(net, 0) AS net FROM t""")
        put("headline_latest", f""", t AS (SELECT year, CAST(SUM(amount) AS DOUBLE) AS net FROM {src}
            WHERE {KEEP} AND year IS NOT NULL GROUP BY year ORDER BY year DESC LIMIT 1)
            SELECT year, net, replace(format('{{:,.0f}}', net), ',', '.') AS shown FROM t""")
        put("explore_yearly", f"SELECT year, CAST(SUM(amount) AS DOUBLE) AS total FROM {src} WHERE {pick} GROUP BY year")
        put("breakdown_type", f"""SELECT grp, n, total FROM (SELECT {type_label} AS grp, {typ} AS raw, {SUMS} FROM {src} WHERE {KEEP}
            GROUP BY {typ} ORDER BY total DESC NULLS LAST, raw NULLS FIRST LIMIT 30)""")
        put("breakdown_buyer", f"""SELECT {buyer} AS grp, {SUMS} FROM {src} WHERE {KEEP} AND year = 1998
            GROUP BY {buyer} ORDER BY total DESC NULLS LAST, grp NULLS FIRST LIMIT 30""")
        put("breakdown_seller", f"""SELECT {seller} AS grp, {SUMS} FROM {src} WHERE {KEEP}
            GROUP BY 1 ORDER BY total DESC NULLS LAST, grp NULLS FIRST LIMIT 10""")
        put("breakdowns", " UNION ALL ".join(
            f"""SELECT * FROM (SELECT '{name}' AS section, {g} AS grp, {SUMS} FROM {src} WHERE {KEEP}
            GROUP BY 2 ORDER BY total DESC NULLS LAST, grp NULLS FIRST LIMIT 10)"""
            for name, g in (("type", typ), ("buyer", buyer), ("seller", seller))))
        at = f"{KEEP} AND {typ} = 'ECONOMY' AND amount > 0"
        shown = f"{SUMS}, {POS}, {NEG} FROM {src}"
        listed = [("year", "year"), ("type", typ), ("buyer", buyer)] + ([("unit", "org1")] if sfx else [])
        put("explorer_page", " UNION ALL ".join(
            [f"SELECT '{k}_options' AS section, CAST({c} AS VARCHAR) AS grp, {shown} WHERE {c} IS NOT NULL GROUP BY {c}"
             for k, c in listed]
            + [f"SELECT 'yearly', CAST(year AS VARCHAR), {shown} WHERE {at} GROUP BY year",
               f"SELECT 'totals', NULL, {shown} WHERE {at} AND year = 1998"]
            + [f"""SELECT * FROM (SELECT '{k}', {c} AS grp, {shown} WHERE {at} AND year = 1998 GROUP BY {c}
                ORDER BY SUM(amount) DESC NULLS LAST, grp NULLS FIRST LIMIT 30)"""
               for k, c in (("type", typ), ("buyer", buyer), ("seller", seller))]
        ))
        put("explore_totals", f"SELECT {SUMS}, {POS}, {NEG} FROM {src} WHERE {pick} AND year = 1998")
        put("explore_totals_empty", f"SELECT {SUMS}, {POS}, {NEG} FROM {src} WHERE {KEEP} AND {typ} = 'NO SUCH TYPE'")
        put("report_top_groups", f"""SELECT {buyer} AS grp, {SUMS}, {POS}, {NEG} FROM {src} WHERE {KEEP} AND year = 1998
            GROUP BY {buyer} ORDER BY ABS(SUM(amount)) DESC NULLS LAST, grp NULLS FIRST LIMIT 30""")
        put("report_yearly", f"SELECT year, CAST(SUM(amount) AS DOUBLE) AS total FROM {src} GROUP BY year")
        put("drill_types_l0", f"SELECT {typ} AS grp, {SUMS} FROM {src} WHERE {KEEP} AND year = 1998 GROUP BY {typ}")
        put("drill_types_l1", f"SELECT {buyer} AS grp, {SUMS} FROM {src} WHERE {KEEP} AND {typ} = 'ECONOMY' GROUP BY {buyer}")
        put("drill_sellers_l0", f"SELECT {seller} AS grp, {SUMS} FROM {src} WHERE {KEEP} GROUP BY 1")
        put("options_distinct", f"SELECT DISTINCT {typ} AS value FROM {src} WHERE {typ} IS NOT NULL")
        put("years_distinct", f"""SELECT DISTINCT year, CAST(year AS VARCHAR)
            || CASE WHEN year = (SELECT MAX(year) FROM {src}) THEN '*' ELSE '' END AS label FROM {src} WHERE year IS NOT NULL""")
        for name, group in (("report_yoy_top", typ), ("report_yoy_top_buyer", buyer)):
            put(name, f""", newest AS (SELECT MAX(year) AS y FROM {src}),
            pair AS (SELECT y, (SELECT MAX(year) FROM {src} WHERE year < y) AS z FROM newest),
            sums AS (SELECT {group} AS grp, SUM(amount) FILTER (WHERE year = y) AS cur, SUM(amount) FILTER (WHERE year = z) AS prev, y, z
              FROM {src}, pair WHERE {group} IS NOT NULL GROUP BY ALL
              HAVING COUNT(*) FILTER (WHERE year = y) > 0 AND COUNT(*) FILTER (WHERE year = z) > 0)
            SELECT grp, CAST(cur AS DOUBLE) AS cur, CAST(prev AS DOUBLE) AS prev,
            CAST(cur - prev AS DOUBLE) AS change, {_pct('cur', 'prev')} AS pct,
            CASE WHEN cur < prev THEN 'down' ELSE 'up' END AS direction, z AS prev_year, y AS cur_year
            FROM sums ORDER BY GREATEST(cur - prev, prev - cur) DESC, grp LIMIT 20""")
        put("analysis_selected_change", f""", y AS (SELECT year, SUM(amount) AS s FROM {src} WHERE {KEEP} AND {typ} = 'ECONOMY' GROUP BY year),
            l AS (SELECT year, s, LAG(s) OVER (ORDER BY year) AS p FROM y)
            SELECT year, CAST(s AS DOUBLE) AS total, {_pct('s', 'p')} AS change_pct FROM l""")
        avg = """gy AS (SELECT {g} AS g, year, SUM(amount) AS s FROM {src} WHERE {g} IS NOT NULL AND {keep} GROUP BY {g}, year),
            gl AS (SELECT g, year, s, (SELECT MAX_BY(e.s, e.year) FROM gy e WHERE e.g = gy.g AND e.year < gy.year) AS p FROM gy),
            av AS (SELECT year, AVG({pct}) AS avg_change_pct FROM gl WHERE p IS NOT NULL AND p <> 0 GROUP BY year)"""
        put("analysis_avg_change", ", " + avg.format(g=typ, src=src, keep=KEEP, pct=_pct("s", "p"))
            + " SELECT year, round(avg_change_pct, 6) AS avg_change_pct FROM av")

        def change_sql(group: str, where: str, src: str = src, avg: str = avg) -> str:
            return (
                ", " + avg.format(g=group, src=src, keep=KEEP, pct=_pct("s", "p"))
                + f""", y AS (SELECT year, SUM(amount) AS s FROM {src} WHERE {where} GROUP BY year),
                l AS (SELECT year, s, LAG(s) OVER (ORDER BY year) AS p FROM y),
                c AS (SELECT year, CAST(s AS DOUBLE) AS total, {_pct('s', 'p')} AS change_pct FROM l)
                SELECT c.year, COALESCE(total, 0) AS total, change_pct, round(avg_change_pct, 6) AS avg_change_pct,
                round(change_pct - avg_change_pct, 6) AS diff_pct FROM c LEFT JOIN av ON c.year = av.year WHERE c.year IS NOT NULL"""
            )

        put("analysis_change", change_sql(buyer, f"{KEEP} AND {buyer} = 'ASIA'"))
        if not sfx:
            put("analysis_unknown_value", change_sql("type", KEEP))
        gy = """g AS (SELECT {g} AS grp, year, SUM(actual_real) AS a, SUM(prior_real) AS p, SUM(yoy_real_change) AS c
            FROM yoy WHERE {g} IS NOT NULL AND {where} GROUP BY {g}, year),
            gp AS (SELECT *, CASE WHEN p = 0 OR p IS NULL THEN NULL ELSE CAST(c AS DOUBLE) / CAST(ABS(p) AS DOUBLE) * 100 END AS pct FROM g)"""
        put("anomaly_score", ", " + gy.format(g=buyer, where="year = 1998") + """
            SELECT grp, COUNT(*) AS years_flagged, CAST(SUM(ABS(c)) AS DOUBLE) AS abs_change_sum, MAX(ABS(pct)) AS max_abs_pct,
            CAST(SUM(ABS(c)) AS DOUBLE) / COUNT(*) AS avg_change_amount
            FROM gp GROUP BY grp ORDER BY abs_change_sum DESC NULLS LAST, grp LIMIT 20""", with_yoy)
        put("anomaly_detail", ", " + gy.format(g=buyer, where=f"yoy_real_pct < 0 AND {typ} = 'ECONOMY'") + """
            SELECT grp, year, CAST(year - 1 AS VARCHAR) || ' → ' || CAST(year AS VARCHAR) AS period,
            CAST(a AS DOUBLE) AS actual_real, CAST(p AS DOUBLE) AS prior_real, CAST(c AS DOUBLE) AS yoy_real_change, pct,
            CASE WHEN COALESCE(c, 0) >= 0 THEN 'up' ELSE 'down' END AS direction
            FROM gp ORDER BY ABS(pct) DESC NULLS LAST, grp, year DESC LIMIT 50""", with_yoy)
        put("anomaly_context", f""", m AS (SELECT {buyer} AS grp, SUM(amount) AS t, COUNT(DISTINCT year) AS years_with_spend
            FROM {src} WHERE {KEEP} AND {typ} = 'ECONOMY' AND {buyer} IS NOT NULL GROUP BY {buyer} ORDER BY ABS(SUM(amount)) DESC, 1 LIMIT 30),
            k AS (SELECT {buyer} AS grp, COUNT(DISTINCT year) AS n FROM yoy
            WHERE {FLAG} AND yoy_real_pct > 0 AND {typ} = 'ECONOMY' AND {buyer} IS NOT NULL GROUP BY {buyer})
            SELECT m.grp, CAST(t AS DOUBLE) AS total_amount, years_with_spend, COALESCE(k.n, 0) AS anomaly_years,
            m.grp = 'ASIA' AS is_selected FROM m LEFT JOIN k ON m.grp = k.grp""", with_yoy)
        put("anomaly_year_series", f""", d AS (SELECT DISTINCT year FROM {src} WHERE year IS NOT NULL),
            m AS (SELECT year, SUM(amount) AS s FROM {src} WHERE {pick} GROUP BY year),
            f AS (SELECT DISTINCT year FROM yoy WHERE {FLAG} AND yoy_real_pct > 0 AND ABS(yoy_real_pct) >= 50
                  AND {typ} = 'ECONOMY' AND {buyer} = 'ASIA'),
            s AS (SELECT d.year, COALESCE(m.s, 0) AS t, f.year IS NOT NULL AS is_anomaly
                  FROM d LEFT JOIN m ON d.year = m.year LEFT JOIN f ON d.year = f.year),
            l AS (SELECT *, LAG(t) OVER (ORDER BY year) AS p FROM s)
            SELECT year, CAST(t AS DOUBLE) AS total, {_pct('t', 'p')} AS change_pct, is_anomaly FROM l""", with_yoy)
    return out


def _pairs_state(*, symmetric: bool = False) -> str:
    """Invoices of large lines that have a counter-entry on the day or up to two days
    later; with ``symmetric`` also those of the counter-entries."""

    def having(line: str, other: str, days: str) -> str:
        return f"""SELECT {line}.invoice FROM state {line} WHERE {line}.invoice IS NOT NULL
          AND {line}.amount <> 0 AND EXISTS (SELECT 1 FROM state {other}
            WHERE {other}.type = {line}.type AND {other}.seller = {line}.seller AND {other}.buyer = {line}.buyer
              AND {days} BETWEEN 0 AND 2 AND sign({other}.amount) <> sign({line}.amount)
              AND {other}.amount + {line}.amount > -1000 AND {other}.amount + {line}.amount < 1000
              AND (l.amount > 50000 OR l.amount < -50000))"""

    sql = having("l", "m", "m.paid_on - l.paid_on")
    if symmetric:
        sql += " UNION " + having("m", "l", "m.paid_on - l.paid_on")
    return f"SELECT DISTINCT invoice FROM ({sql})"


_CITY_NEAR = " AND ".join(
    [f"m.{k} IS NOT DISTINCT FROM l.{k}" for k in reversed(CITY_PAIR)]
    + ["m.year = l.year", "sign(m.amount) = -sign(l.amount)", "m.amount + l.amount > -1000", "m.amount + l.amount < 1000"]
)
_CITY_BASE = (
    "year, CAST(amount AS DOUBLE) AS amount, org0, org1, org2, org3, org4, type0, type1, type2, type3, type4, "
    "company, company_label, vat_no, vat_name, expense_code, expense_label"
)
_CITY_IDS = (
    f"{CITY}, numbered AS (SELECT row_number() OVER () AS id, * FROM city), "
    "light AS MATERIALIZED (SELECT * FROM numbered), "
    f"hit AS (SELECT l.id FROM light l WHERE abs(l.amount) > 50000 AND EXISTS (SELECT 1 FROM light m WHERE {_CITY_NEAR}))"
)

_LINES = "SELECT year, buyer, seller, type, CAST(amount AS DOUBLE) AS amount, paid_on FROM state"

SQL: dict[str, str] = {
    **_ledgers(),
    "scan_ledger": """SELECT l_returnflag AS flag, l_linestatus AS status, COUNT(*) AS n,
        CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY 1, 2""",
    "scan_with_year": _state(f"SELECT year, buyer, {SUMS} FROM state GROUP BY year, buyer"),
    "sink_by_year": _state(f"SELECT type, paid_on, {SUMS} FROM state WHERE year = 1998 GROUP BY type, paid_on"),
    "sink_yoy": f"WITH {STATE_YOY} SELECT {_yoy_out(STATE_GRAIN)} FROM yoy",
    "combine_chunks": _state(
        f"SELECT CAST(date_trunc('month', paid_on) AS DATE) AS month, type, {SUMS} FROM state GROUP BY 1, 2"
    ),
    "export_ingest": _state(f"""SELECT paid_on, buyer, type || '"x", "\\' || chr(10) || 'y' AS type, {SUMS}
        FROM state GROUP BY paid_on, buyer, type"""),
    "csv_ingest": _city(
        f"""SELECT year, org0, org1 || '"x"; "\\' || chr(10) || 'y' AS org1, org2, type0, type1,
        {SUPPLIER} AS supplier_name, FALSE AS is_correction, {SUMS}
        FROM city GROUP BY ALL"""
    ),
    "union_years": _city("""SELECT year, COUNT(*) AS n,
        COUNT(CASE WHEN year % 2 = 1 THEN expense_code END) AS with_code,
        COUNT(CASE WHEN year % 2 = 1 THEN expense_label END) AS with_label,
        CAST(SUM(amount) AS DOUBLE) AS total FROM city GROUP BY year"""),
    "normalize_columns": _city(f"SELECT year, org2, type0, {SUMS} FROM city GROUP BY year, org2, type0"),
    "anomaly_source": f"""WITH {STATE_YOY} SELECT buyer AS grp, year, COUNT(*) AS n,
        CAST(SUM(actual_real) AS DOUBLE) AS actual_real FROM yoy GROUP BY buyer, year""",
    "high_water_mark": _state(
        "SELECT MAX(paid_on) AS max_date, CAST(date_trunc('month', MAX(paid_on)) AS DATE) AS month_start FROM state"
    ),
    "month_chunks": _state(""", b AS (SELECT MIN(paid_on) + 14 AS lo, MAX(paid_on) AS hi FROM state),
        m AS (SELECT CAST(unnest(generate_series(date_trunc('month', lo), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS s,
              CAST(lo AS DATE) AS lo, hi FROM b),
        c AS (SELECT greatest(s, lo) AS chunk_start, least(last_day(s), hi) AS chunk_end FROM m)
        SELECT chunk_start, chunk_end, strftime(chunk_start, '%Y%m%d') || '_' || strftime(chunk_end, '%Y%m%d') AS label,
        strftime(chunk_start, '%d.%m.%Y') AS from_text, strftime(chunk_end, '%d.%m.%Y') AS to_text FROM c"""),
    "incremental_refresh": _state(
        f"""SELECT CAST(date_trunc('month', paid_on) AS DATE) AS month, buyer, type, {SUMS} FROM state GROUP BY 1, 2, 3"""
    ),
    "catalog_resources": """SELECT url, 'annual_' || CAST(page_id % 9 + 2014 AS VARCHAR) AS name FROM pages
        UNION ALL SELECT url || '/x', CASE WHEN page_id % 3 <> 0 THEN 'extra-' || CAST(page_id % 9 + 2014 AS VARCHAR)
        ELSE 'resource' END FROM pages WHERE page_id % 4 <> 0""",
    "catalog_resources_years": """SELECT * FROM (SELECT url, 'annual_' || CAST(page_id % 9 + 2014 AS VARCHAR) AS name FROM pages
        UNION ALL SELECT url || '/x', CASE WHEN page_id % 3 <> 0 THEN 'extra-' || CAST(page_id % 9 + 2014 AS VARCHAR)
        ELSE 'resource' END FROM pages WHERE page_id % 4 <> 0) WHERE name LIKE '%2015%' OR name LIKE '%2019%'""",
    "explore_filter": _state(f"""SELECT seller, paid_on, {SUMS} FROM state
        WHERE {KEEP} AND year = 1998 AND type = 'ECONOMY' AND buyer = 'ASIA' GROUP BY seller, paid_on"""),
    "explore_filter_unit": _city(f"""SELECT year, org0, {SUMS} FROM city
        WHERE {KEEP} AND org1 = 'NATION_6' AND type0 = 'ECONOMY' GROUP BY year, org0"""),
    "anomaly_filter_city": f"""WITH {CITY_YOY} SELECT {_yoy_out(CITY_GRAIN)} FROM yoy
        WHERE year = 1998 AND yoy_real_pct > 0 AND ABS(yoy_real_pct) >= 50""",
    "option_search_city": _city("SELECT DISTINCT org3 FROM city WHERE contains(lower(org3), '12')"),
    "combine_chunks_city": _city(f"SELECT year, org0, type1, {SUMS} FROM city GROUP BY ALL"),
    "sign_filter": _city(f"SELECT year, org1, {SUMS} FROM city WHERE amount < 0 GROUP BY year, org1"),
    "supplier_filter": _city(f"SELECT year, {SUMS} FROM city WHERE {SUPPLIER} = 'VAT NATION_6' GROUP BY year"),
    "anomaly_filter": f"""WITH {STATE_YOY} SELECT {_yoy_out(STATE_GRAIN)} FROM yoy
        WHERE year = 1998 AND yoy_real_pct > 0 AND ABS(yoy_real_pct) >= 50""",
    "option_search": _state("SELECT DISTINCT seller FROM state WHERE contains(lower(seller), 'nation_1')"),
    "option_search_index": _state("SELECT DISTINCT seller FROM state WHERE contains(lower(seller), 'nation_1')"),
    "option_search_index_city": _city("SELECT DISTINCT org3 FROM city WHERE contains(lower(org3), '12')"),
    "preview_page": _state(f"""{_LINES} WHERE {KEEP}
        ORDER BY paid_on DESC NULLS LAST, year NULLS FIRST, buyer NULLS FIRST, seller NULLS FIRST,
        type NULLS FIRST, state.amount NULLS FIRST LIMIT 50 OFFSET 100"""),
    "preview_page_city": _city(f"""SELECT year, org0, org1, type0, type1, CAST(amount AS DOUBLE) AS amount, {SUPPLIER} AS supplier_name
        FROM city WHERE {KEEP} ORDER BY year DESC NULLS LAST, org0 NULLS FIRST, org1 NULLS FIRST, type0 NULLS FIRST,
        type1 NULLS FIRST, city.amount NULLS FIRST, supplier_name NULLS FIRST LIMIT 50 OFFSET 100"""),
    "preview_far_page": _state(f"""{_LINES}
        ORDER BY paid_on DESC NULLS LAST, year NULLS FIRST, buyer NULLS FIRST, seller NULLS FIRST,
        type NULLS FIRST, state.amount NULLS FIRST LIMIT 500 OFFSET 20000"""),
    "preview_far_page_city": _city("""SELECT year, org0, org1, type0, type1, CAST(amount AS DOUBLE) AS amount, company
        FROM city ORDER BY year DESC NULLS LAST, org0 NULLS FIRST, org1 NULLS FIRST, type0 NULLS FIRST,
        type1 NULLS FIRST, city.amount NULLS FIRST, company NULLS FIRST LIMIT 500 OFFSET 20000"""),
    "preview_display_names": _state(f"""SELECT year AS "Ár", buyer AS "Stofnun (kaupandi)", seller AS "Birgir", type AS "Tegund",
        CAST(amount AS DOUBLE) AS "Upphæð", paid_on AS "Dags." FROM state
        WHERE {KEEP} AND year = 1998 AND type = 'ECONOMY' AND buyer = 'ASIA'
        ORDER BY paid_on DESC, year, buyer, seller, type, state.amount LIMIT 500"""),
    "correction_pairs_window": _state(_pairs_state()),
    "correction_pairs_symmetric": _state(_pairs_state(symmetric=True)),
    "correction_pairs_nullsafe": f"""WITH {_CITY_IDS}
        SELECT {_CITY_BASE}, is_correction FROM light WHERE id IN (SELECT id FROM hit)""",
    "flag_corrections_invoice": _state(f""", hit AS ({_pairs_state()})
        SELECT year, buyer, seller, type, CAST(amount AS DOUBLE) AS amount, paid_on, invoice,
        invoice IN (SELECT invoice FROM hit) AS is_correction FROM state"""),
    "flag_corrections_row": f"""WITH {_CITY_IDS}
        SELECT {_CITY_BASE}, id IN (SELECT id FROM hit) AS is_correction FROM light""",
    "yoy_state": f"WITH {STATE_YOY} SELECT {_yoy_out(STATE_GRAIN)} FROM yoy",
    "incremental_yoy": f"WITH {STATE_YOY} SELECT {_yoy_out(STATE_GRAIN)} FROM yoy",
    "incremental_yoy_city": f"WITH {CITY_YOY} SELECT {_yoy_out(CITY_GRAIN)} FROM yoy",
    "yoy_city": f"WITH {CITY_YOY} SELECT {_yoy_out(CITY_GRAIN)} FROM yoy",
    "drill_sellers_l1": _state(f"""SELECT buyer AS grp, {SUMS} FROM state
        WHERE {KEEP} AND seller = 'NATION_3' AND year = 1998 GROUP BY buyer"""),
    "drill_bad_year": _state(f"SELECT type AS grp, {SUMS} FROM state WHERE {KEEP} AND year = 0 GROUP BY type"),
    "drill_sellers_adaptive": _city(f"""SELECT COALESCE(expense_label, expense_code, '(óskráð)') AS grp, {SUMS} FROM city
        WHERE {KEEP} AND {SUPPLIER} = 'VAT NATION_6' GROUP BY expense_code, expense_label"""),
    "drill_sellers_adaptive_units": _city(f"""SELECT COALESCE(org0, '(óskráð)') AS grp, {SUMS} FROM city
        WHERE {KEEP} AND {SUPPLIER} = 'VAT NATION_10' GROUP BY org0"""),
    "vat_lookup": _city(f"""SELECT DISTINCT {SUPPLIER} AS supplier_name, vat_no,
        CASE WHEN vat_no > 0 THEN '{VAT_PAGE}' || CAST(vat_no AS VARCHAR) END AS vsk_link
        FROM city WHERE vat_no IS NOT NULL"""),
    "vat_coverage": _city(f"""SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT {SUPPLIER} AS s, vat_no FROM city
        WHERE vat_no IS NOT NULL)) AS with_vat, COUNT(DISTINCT {SUPPLIER}) AS suppliers FROM city"""),
    "vat_template": _state("""SELECT DISTINCT COALESCE(NULLIF(TRIM(seller), ''), '(óskráð)') AS seller_name,
        CAST(NULL AS VARCHAR) AS vm_numer, CAST(NULL AS VARCHAR) AS vsk_link FROM state"""),
    "vat_template_coverage": _state("""SELECT COUNT(DISTINCT COALESCE(NULLIF(TRIM(seller), ''), '(óskráð)')) AS sellers,
        CAST(0 AS BIGINT) AS with_vat FROM state"""),
    "parse_local_number": """SELECT l_linenumber, COUNT(*) AS n,
        COUNT(CASE WHEN l_linenumber > 2 THEN 1 END) AS parsed,
        CAST(SUM(CASE WHEN l_linenumber > 3 THEN CAST(l_extendedprice AS DECIMAL(18,2))
                      WHEN l_linenumber = 3 THEN -CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS total
        FROM lineitem GROUP BY l_linenumber""",
    "format_amount": _state("""SELECT seller, year, replace(format('{:,.0f}', CAST(SUM(amount) AS DOUBLE)), ',', '.') AS shown
        FROM state GROUP BY seller, year"""),
    "format_pct": f"""WITH {STATE_YOY} SELECT year, buyer, seller, type,
        CASE WHEN yoy_real_pct IS NULL THEN '–' ELSE printf('%+.1f%%', yoy_real_pct) END AS shown FROM yoy""",
    "supplier_name": _city(f"SELECT {SUPPLIER} AS supplier_name, {SUMS} FROM city GROUP BY 1"),
    "missing_label": _city(f"""SELECT COALESCE(NULLIF(TRIM(company), ''), '(óskráð)') AS seller_name, {SUMS}
        FROM city GROUP BY 1"""),
    "year_from_name": """SELECT page_id, CAST(NULLIF(regexp_extract(html, '(19|20)[0-9]{2}'), '') AS INTEGER) AS year FROM pages""",
    "extract_entity_id": """SELECT page_id, NULLIF(regexp_extract(html, '\\b[0-9]{10}\\b'), '') AS entity FROM pages""",
    "export_dates": _state("SELECT strftime(paid_on, '%d.%m.%Y') AS day, COUNT(*) AS n FROM state GROUP BY 1"),
    "active_vat": """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN NULL
        WHEN 1 THEN CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST(s_suppkey * 10 + 1 AS VARCHAR) END
        WHEN 2 THEN CAST(s_suppkey * 10 + 1 AS VARCHAR)
        ELSE CASE WHEN s_acctbal >= 0 OR s_suppkey % 3 = 0 THEN CAST(s_suppkey * 10 + 1 AS VARCHAR)
             ELSE CAST(s_suppkey * 10 + 2 AS VARCHAR) END END AS vat FROM supplier""",
}

_SELLERS = f"""sellers AS (
  SELECT DISTINCT COALESCE(NULLIF(TRIM(seller), ''), '(óskráð)') AS seller FROM state WHERE seller IS NOT NULL
  UNION
  SELECT DISTINCT COALESCE(NULLIF(TRIM(company_label), ''), NULLIF(TRIM(company), ''),
         NULLIF(TRIM(CAST(vat_no AS VARCHAR)), '')) FROM city
)"""
SQL["sellers_union"] = f"WITH {STATE}, {CITY}, {_SELLERS} SELECT seller FROM sellers"
SQL["vat_enrich"] = f"""WITH {STATE}, {CITY}, {_SELLERS},
  answers AS (SELECT 'NATION_' || CAST(s_nationkey AS VARCHAR) AS name, vat FROM supplier
              JOIN ({SQL['active_vat']}) v USING (s_suppkey)),
  numbers AS (SELECT name, MIN(vat) AS vm_numer FROM answers WHERE vat IS NOT NULL GROUP BY name)
  SELECT seller AS seller_name, vm_numer, '{VAT_PAGE}' || vm_numer AS vsk_link
  FROM sellers LEFT JOIN numbers ON seller = name"""


def all_sql() -> dict[str, str]:
    return dict(SQL)
