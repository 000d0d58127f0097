"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the data folder, BENCH_CPUS the local cores, BENCH_QUERIES a
comma-separated list instead of the default one. Every query is computed in full (all
rows and columns) and timed from plan building to the last row; the reported time is
the better of two runs, after one untimed start-up query.
"""

from __future__ import annotations

import json
import os
import time

from storepulse.plans import registry
from storepulse.session import local_session

HEADLINE = [
    "stg_orders", "stg_order_items", "stg_order_payments",
    "fct_orders", "fct_daily_revenue", "dim_customers", "dim_sellers", "fct_seller_monthly", "fct_lead_funnel",
    "dq_payment_reconciliation", "dq_orphan_keys", "dq_possible_duplicate_orders", "dq_volume_anomalies",
    "dq_summary", "run_checks",
    "weekly_revenue", "forecast_backtest", "forecast_backtest_all_models", "weekly_forecast_all_models",
    "monthly_plan_fitted",
    "funnel_overall", "funnel_by_origin", "funnel_by_segment", "funnel_timing",
    "customer_cohort_retention", "customer_retention_summary", "rfm_customer_scores", "rfm_segments",
    "customer_monthly_churn", "seller_cohort_retention", "seller_churn_by_size",
    "revenue_mom", "revenue_by_slicer", "customer_churn_setwise",
]


def run_once(build, spark, folder: str) -> float:
    start = time.perf_counter()
    build(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(app="storepulse-bench")
    queries = registry.queries()
    run_once(queries["dq_base_count"], spark, folder)
    seconds = {}
    for name in names:
        seconds[name] = round(min(run_once(queries[name], spark, folder) for _ in range(2)), 3)
    print(json.dumps({
        "metric": "total time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": os.environ.get("BENCH_CPUS", "8"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
