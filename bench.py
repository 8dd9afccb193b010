"""Time the headline queries; prints one JSON line.

Each query runs once to warm up, then ``BENCH_RUNS`` times (once unless set); its figure is the median, with
results written to Spark's no-op sink so that every column of every row is produced.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from prospectry.catalog.all import QUERIES  # noqa: E402
from prospectry.session import build_session  # noqa: E402

HEADLINE = [
    "merge_listings", "merge_appearances", "dedup_summary", "mark_included", "parse_categories", "query_slug",
    "expected_outputs", "latest_evaluation", "attach_latest_eval", "apply_eval_to_parent", "category_histogram",
    "extract_listings", "merge_panel_fields", "page_features", "detect_frameworks", "detect_site_builder",
    "is_responsive", "check_sitemap", "http_policy", "site_profile", "score_sum", "sort_reasons", "document_words",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus, "spark.sql.files.maxPartitionBytes": "1m", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in wanted:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total of per-query medians", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
