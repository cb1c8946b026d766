"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from credsieve.plans.queries import QUERIES  # noqa: E402
from credsieve.session import local_session, remove_settled  # noqa: E402

HEADLINE = (
    "document_findings", "text_table_hits", "contexts_of_lines", "redacted_documents",
    "document_structure", "findings_by_rule", "planted_findings", "history_findings",
    "config_filtered", "baseline_suppressed", "severity_ordered_report", "heuristic_verdicts",
    "similar_verified", "pseudo_embeddings", "streamed_findings",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "credsieve-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # The JVM compiles itself warm on the first query; that is not a query's cost.
    QUERIES["document_findings"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]:.2f}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries after one warm-up, summed",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    remove_settled(spark)
    spark.stop()


if __name__ == "__main__":
    main()
