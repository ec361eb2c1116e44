"""Times the headline queries and prints one JSON line.

Every query is written whole to the ``noop`` sink. One warm-up run is followed by
three timed runs, of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from orderlens import registry  # noqa: E402
from orderlens.session import build_session  # noqa: E402

HEADLINES = (
    "kpi_overall", "kpi_monthly_full", "cust_profile", "rfm_segment_summary", "category_sales",
    "category_reviews", "prod_performance", "seller_avg_price", "seller_specialisation",
    "pay_installment_share", "deliv_reviews", "cohort_retention", "pareto_deciles",
    "seller_rank_in_category", "running_and_moving", "customer_revenue_top10",
    "vw_sales", "vw_customers", "vw_products", "vw_sellers", "vw_payments", "vw_delivery", "vw_reviews",
    "vw_monthly_sales", "m_core", "m_category_table", "m_ontime_pct", "m_repeat_rate", "fk_check",
    "zip_location_counts", "final_validation", "profile_table", "star_relationships", "load_count_check", "m_takeaways",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.queries(), {}
    for key in HEADLINES:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[key](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[key] = round(statistics.median(times[1:]), 3)
        print(f"{key}: {seconds[key]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": f"headline queries, median of {runs} warm runs, local[{cpus}]",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
