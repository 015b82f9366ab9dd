"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "zone_price_m2_by_polygon",
    "search_visible",
    "search_radius",
    "documents_word_search",
    "sorted_first_page",
    "nearby_of_positions_250",
    "zone_price_statistics",
    "zone_type_matrix",
    "dashboard_summaries",
    "dashboard_counts",
    "price_segments",
    "iqr_mad_outliers",
    "hedonic_fit",
    "opportunity_score",
    "security_arbitrage",
    "zone_or_nearest",
    "nearby_point_list",
    "score_location",
    "poi_zone_scores",
    "ingest_resolution",
    "missing_report",
    "discovery_resolution",
    "duplicate_components",
    "field_diff",
    "canonical_adverts",
    "parsed_numbers",
    "advert_page_fields",
    "accepted_trace_points",
    "trip_encounters",
    "monthly_series",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from casagrid.plans import queries
    from casagrid.session import build_session

    spark = build_session(
        "casagrid-bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = queries()
    registry["unblocked_adverts"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    start = time.time()
    registry["page_total"](spark, folder).collect()
    times["write_curated_table"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        registry[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
