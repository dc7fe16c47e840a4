"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is fully materialised to a sink that discards rows: one warm-up, then the better
of two runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from valora.bindings import catalog  # noqa: E402
from valora.session import local_session  # noqa: E402

HEADLINE = (
    "AGG-01",
    "DEC-01",
    "DEC-02",
    "AGG-09",
    "AGG-10",
    "OFR-04",
    "CMP-01-counts",
    "SEM-02",
    "KNW-04",
    "PRC-02",
    "PRC-08",
    "PRO-01",
    "PRO-11",
    "AGG-16",
    "SRC-03",
    "SRC-04",
    "SRC-07",
    "WEB-01",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    registered = catalog.queries()
    seconds = {}
    for name in HEADLINE:
        best = None
        for attempt in range(int(os.environ.get("BENCH_RUNS", "2"))):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        seconds[name] = round(best, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
