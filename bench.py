"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Results go to a sink that keeps nothing."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "institution_ranking", "collaboration_edges", "co_authorship_edges", "author_centrality", "technology_trends", "graph_edges", "institution_profiles", "gap_method_combinations", "gap_temporal",
    "gap_future_work", "validate_papers", "rank_papers", "landscape_sections", "landscape_clusters", "vector_search", "context_budget", "chunk_documents", "windows_session", "stage_attempts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    from sparkfolio.plans import registry
    from sparkfolio.session import session

    n = os.cpu_count() if cpus == "*" else int(cpus)
    spark = session(f"local[{cpus}]", n, **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    registry.QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    for name in HEADLINE:
        best = float("inf")
        for _ in range(runs):
            began = time.perf_counter()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
