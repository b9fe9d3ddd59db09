"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from sunloom.plans import PLANS
from sunloom.session import local_session

HEADLINE = [
    "risk_profile", "roll_mean", "roll_std", "alarm_streak", "lookahead_label", "zscore_flags", "category_transitions",
    "ffill", "lag_features", "downsample", "iqr_bounds", "winsorise", "chrono_split", "standardise", "manual_vector", "batch_predict",
    "isolation_forest", "global_importance", "linear_attribution", "macro_metrics", "macro_auc", "fleet_status",
    "alerts_star", "paged_alerts", "latest_row_number", "operator_status", "kpi_eis", "green_report", "revenue_lost",
    "stale_inverters", "chunk_text", "cosine_topk", "topk_attribution", "prompt_table", "model_metrics", "trace_by_name",
    "trace_percentiles", "high_risk_tickets", "retrieved_context", "stream_alerts", "smote_balance",
    "boosted_report", "tree_explanations", "kpi_rollup", "index_exact", "stream_features",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    PLANS["fleet_status"](spark, folder).collect()  # JVM warm-up
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        start = time.perf_counter()
        PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                      "scored_rows_per_second": round(rows / times["batch_predict"]) if "batch_predict" in times else None}))


if __name__ == "__main__":
    main()
