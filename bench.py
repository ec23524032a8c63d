"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from aislerank.plans import registered
from aislerank.session import build_session

HEADLINE = (
    "S5_serving_seed", "V9_issue_table", "N6_drop_incomplete", "F1_combined_text", "F8_popularity",
    "X3_tfidf_weights", "E3_category_similarity", "E5_brand_similarity", "E7_price_similarity",
    "E9_popularity", "E11_trending", "E13_bought_together", "Q8_keyword_search", "I1_repeat_views",
    "P5_dominant_signal", "D4_drift_grades", "L1_co_purchases", "L2_windowed_trend",
    "X6_all_pairs_top", "E19_hybrid",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus)
    registered.QUERIES["F8_popularity"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for key in chosen:
        start = time.perf_counter()
        registered.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        print(key, times[key], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
