"""Benchmark: the headline pricing queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Each query is forced to run in full (noop sink); the
pricing runs are not shared between queries, so every price_* figure
includes its own rollup, folds, 60 fits, scoring and pricing.

Before timing, the same queries run once on sf0.001 (not timed), so that
JIT/codegen compilation and Python worker start-up, which a long-running
application pays once, are not charged to the first timed query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ratewise.plans import queries as Q  # noqa: E402
from ratewise.session import get_spark  # noqa: E402

HEADLINE = ("exposure_rollup_count", "price_m1", "price_m2", "price_m3", "compare_variants")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    # warm-up on the smallest data (not timed)
    for name in HEADLINE[:-1]:
        Q._RUNS.clear()
        Q.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        Q._RUNS.clear()
        t = time.time()
        Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
