"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

All queries run once to warm up, then each three times; the median counts.  A run is
everything from reading schemas to the last row, which goes to a sink that keeps none.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from edgeframe.plans import all_queries  # noqa: E402
from edgeframe.session import make_session  # noqa: E402

HEADLINE = [
    "spmv", "spmm", "two_selectors_map", "multi_reducer", "map_and_reduce_red", "global_sum",
    "vec_arith", "subset_gather_scatter", "csr_offsets", "csr_to_coo", "segment_sum",
    "segment_running_sum", "mesh_geometry", "mesh_shared_face", "edge_divergence",
    "iterate_k", "compare_close",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = make_session(f"local[{cpus}]", "edgeframe-bench", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "12g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="edgeframe-bench-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    built = all_queries()

    def once(name: str) -> float:
        start = time.perf_counter()
        built[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        once(name)
    for name in names:
        times[name] = round(statistics.median(once(name) for _ in range(RUNS)), 4)
        print(f"{name}: {times[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
