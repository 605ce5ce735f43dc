"""Times the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; prints one JSON line.

Every query is planned and run into a sink that takes all rows and keeps none; the time is the
shorter of two runs, so that start-up and compilation don't count.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark.plans.queries import queries

HEADLINE = """hot_items_topn hot_items_offset page_view_hourly unique_visitors_hourly unique_visitors_bitmap session_activity hot_urls_filtered
channel_behavior_counts over_range_count_sum row_count_window rolling_min window_min_by table_agg_top2 pairwise_avg word_count temperature_jump
rise_alert login_fail_strict order_pay_pattern order_match_outcomes ad_click_by_region interval_join interval_join_bucketed window_join
tx_match_outer asof_version_join cogroup_left dim_enrich split_lateral cdc_latest_left_join json_route upsert_latest merge_sum scalar_functions binlog_etl""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, times = queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
