"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from civicpulse.session import build_session
from civicpulse.plans.registry import QUERIES

HEADLINE = (
    "city_mentions", "track_filter", "clean_tokens", "bigram_counts", "nb_likelihood", "nb_classify",
    "informative_features", "geo_enrich", "post_stats", "post_stats_dense", "stats_json", "page_posts",
    "page_links", "first_rule_links", "url_dedupe", "city_propagation", "forum_posts", "site_links",
    "parse_dates", "stream_posts", "stream_dedupe", "enriched_posts", "post_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "civicpulse-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
           "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.host": "localhost", "spark.driver.bindAddress": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    # The first query of a JVM pays for class loading and compilation.
    QUERIES["post_totals"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(folder.rstrip("/").rsplit("sf", 1)[-1]), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
