"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores. Each query runs once to warm
up and then ``BENCH_RUNS`` times (default 3); the median counts. Results are consumed in
full by a sink that discards them.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from askloom.checks import CHECKS  # noqa: E402
from askloom.session import local_session  # noqa: E402

HEADLINES = [
    "vector_topk",
    "vector_topk_grid",
    "vector_nearest",
    "chunk_lines",
    "chunk_paragraphs",
    "context_build",
    "answer_records",
    "search_json",
    "toolcall_first",
    "toolcall_steps",
    "run_answer",
    "session_memory",
    "reply_reassemble",
    "reply_reassemble_events",
    "frame_roundtrip",
    "upsert_points",
    "predict_batch",
    "lexical_search",
    "stream_chunks",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    CHECKS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINES
    spark = local_session(cpus, "askloom-bench")
    times = {}
    for name in names:
        run(spark, name, sf_dir)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
