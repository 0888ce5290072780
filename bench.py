"""Seconds per headline query: ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tallywise.plans.catalog import QUERIES

HEADLINE = (
    "monthly_summary", "monthly_boxplot", "top_agencies", "top_vendors", "mccs_per_vendor",
    "vendor_mcc_median", "ratio_to_mean", "ratio_to_median", "ratio_bins", "posting_lag_stats",
    "cardholder_mom", "vendor_mom_trimmed", "vendor_monthly_spike", "refund_cardholder",
    "velocity_day_vendor", "velocity_week_cardholder", "days_since_last", "gap_bins", "flagged_share",
    "profile_columns", "impute_mean", "woe_apply", "roc_points", "auc_exact", "gains_table",
    "tokens_clean", "tfidf_weights", "lexicon_sentiment", "point_in_polygon", "mode_color",
    "kmeans_palette", "decode_boxes", "nms_boxes", "timeline_segments", "stream_velocity",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Load classes once, so that the first query does not pay for all.
    QUERIES["monthly_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
