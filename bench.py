"""Benchmark: run the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed in full with the ``noop`` sink (nothing is collected).
``setup_sec`` is the one-time cost of materialising the ``code_files`` input
table; it is reported separately and not part of ``value``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codeskel.plans import queries as Q  # noqa: E402
from codeskel.session import get_spark  # noqa: E402
from codeskel.sources.fixtures import code_files  # noqa: E402

HEADLINE = [
    "file_skeleton_metrics",
    "skeleton_python",
    "skeleton_js_ts",
    "skeleton_c_like",
    "repo_summary",
    "scan_history_last20",
    "skeleton_map",
    "sequence_diagram",
    "find_references",
    "find_references_multi",
    "file_lines",
    "compress_messages",
    "prompt_assembly",
    "repo_ref_normalise",
    "callable_candidates",
    "method_bodies",
    "find_references_code",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="codeskel-bench")
    t0 = time.time()
    code_files(spark, sf_dir).count()
    setup = time.time() - t0
    times = {}
    for name in HEADLINE:
        t = time.time()
        getattr(Q, name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "setup_sec": round(setup, 3),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
