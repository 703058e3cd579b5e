"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
Every query is written whole to a sink that drops the rows.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from foliant import build_session  # noqa: E402
from foliant.plans import registered  # noqa: E402

HEADLINE = (
    "bm25_search", "bm25_without_index", "search_library", "posting_lists", "bates_numbering", "load_file", "opticon_rows",
    "size_clusters", "auto_logos", "exclusion_decisions", "attachment_dispositions", "auto_flags_web", "excluded_groups",
    "similar_pairs", "hash_groups", "incremental_reindex", "drifted_families", "lint_findings", "citation_checks",
    "html_to_text", "run_progress", "token_totals", "chronology", "csv_lines",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()[0]
    names = sys.argv[1:] or HEADLINE
    queries["token_totals"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not measured
    times = {}
    for name in names:
        t = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(sf[1]) if sf else None, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
