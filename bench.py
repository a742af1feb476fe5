"""Benchmark: headline reports at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Each query runs once to warm up, then BENCH_RUNS times
(default 5); the reported time is the median. Queries run to completion with
the `noop` sink, so the whole plan executes without collecting rows.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from thali import catalog  # noqa: E402
from thali.session import get_spark  # noqa: E402

HEADLINE = [
    "sales_overview", "best_sellers", "worst_sellers", "sales_by_category", "revenue_trend",
    "payment_method_mix", "peak_hours", "top_customers", "customers_with_stats", "menu_with_ratings",
    "orders_listing", "customer_orders_nested", "ordered_items", "dashboard_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark()
    times, failed = {}, {}
    for name in names:
        try:
            catalog.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples = []
            for _ in range(runs):
                t0 = time.perf_counter()
                catalog.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
                samples.append(time.perf_counter() - t0)
            times[name] = round(statistics.median(samples), 4)
        except Exception as e:  # noqa: BLE001 - one failing query must not hide the others
            failed[name] = str(e).splitlines()[0][:200]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_reports_total_median",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
