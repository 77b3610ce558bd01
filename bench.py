"""Wall time of headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from leafmill.plans import QUERIES
from leafmill.session import local_session

HEADLINES = (
    "tree_nodes", "tree_lines", "find_by_name", "glob_paths", "grep_literal", "grep_regex", "grep_context",
    "grep_many", "view_line_table", "text_tokens", "text_passages", "text_metadata", "index_text",
    "search_top_documents", "search_candidates", "search_passages", "search_substrings", "search_english",
    "write_put_log", "write_result", "summary_child_sources", "summary_rollup", "stream_bursts",
    "evidence_recall", "record_accuracy",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINES)
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "tree_nodes", folder)  # start of the JVM and the Python workers
    run(spark, "text_metadata", folder)
    times = {}
    for name in names:
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(repeats)), 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
