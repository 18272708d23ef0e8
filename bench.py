"""Time the headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from spendlens.session import build_session
from verification.queries import all_queries

HEADLINE = [
    "headline_yearly",
    "explore_totals",
    "breakdown_type",
    "breakdown_buyer",
    "breakdown_seller",
    "breakdown_seller_city",
    "breakdowns_city",
    "preview_page",
    "preview_far_page",
    "analysis_change",
    "analysis_avg_change_city",
    "report_top_groups",
    "report_yoy_top",
    "drill_sellers_l0_city",
    "drill_sellers_adaptive",
    "yoy_state",
    "yoy_city",
    "flag_anomalies_city",
    "anomaly_score_city",
    "anomaly_detail",
    "anomaly_context_city",
    "anomaly_year_series",
    "correction_pairs_window",
    "correction_pairs_nullsafe",
    "flag_corrections_invoice",
    "flag_corrections_row",
    "sellers_union",
    "vat_lookup",
    "vat_enrich",
    "combine_chunks",
    "csv_ingest",
    "incremental_refresh",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # The first run compiles the generated code of a query; the second one is
    # its throughput.
    first, seconds = {}, {}
    for name in names:
        first[name] = run(name)
        seconds[name] = round(run(name), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run_total": round(sum(first.values()), 3),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
