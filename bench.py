"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "type_distribution", "recency_stats", "incident_cube", "type_patterns", "recency_weights", "normalized_incidents",
    "holiday_effect", "seasonal_verdicts", "density_grid", "daily_series_by_key", "forecast_daily",
    "forecast_daily_many_series", "extract_predictions", "density_clusters", "hotspots",
]


def main() -> None:
    from checks import QUERIES
    from hotspan.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors outside the timings
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
