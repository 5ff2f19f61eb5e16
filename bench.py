"""Seconds per headline query, as one JSON line.

BENCH_SF_DIR names the tables (default: scale 0.1), BENCH_CPUS the number of local cores. Every query
reads its tables anew and produces all of its rows, which a no-op sink discards.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultline.operators import search  # noqa: E402
from faultline.plans import checks  # noqa: E402
from faultline.plans.checks import views  # noqa: E402
from faultline.plans.checks.search import TEXT  # noqa: E402
from faultline.session import session  # noqa: E402

HEADLINE = (
    "profile_scalars", "profile_histogram", "profile_components", "profile_timeline", "profile_table",
    "recent_reports", "timeline_dense", "component_shares",
    "catalog", "catalog_recall_counts", "overview", "make_ranking", "make_models", "most_reported",
    "taxonomy_table", "taxonomy_top_vehicles", "component_shape",
    "campaign_detail", "campaign_vehicles", "latest_advisories", "recall_summary", "recall_fold",
    "compare_components", "compare_mileage", "request_status",
    "search_text", "search_page", "inverted_index", "snippets",
    "complaint_rows", "recall_rows", "ingest_metrics", "upsert_latest",
)


def stored_index_page(spark, sf_dir: str) -> float:
    """Seconds for one page of a text search through an index that is stored beforehand, untimed."""
    reports, path = views.narratives(spark, sf_dir), tempfile.mkdtemp(prefix="index-")
    search.write_inverted_index(search.inverted_index(reports), path)
    start = time.perf_counter()
    matched = search.search_index(spark.read.parquet(path), reports, TEXT)
    search.search_page(matched, TEXT, ["id", "vehicle_key"], ["id"]).collect()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = session(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Warm up the JVM untimed, so that the first query is not charged for starting it.
    checks.queries()["profile_timeline"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        checks.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    if not sys.argv[1:]:
        seconds["stored_index_page"] = stored_index_page(spark, sf_dir)
    print(
        json.dumps(
            {
                "metric": "seconds over all headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
