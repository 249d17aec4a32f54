"""Times the registered queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from evlake.plans import QUERIES
from evlake.session import local_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = asked.split(",") if asked else list(QUERIES)
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "16g"), app="evlake-bench")
    spark.sparkContext.setLogLevel("OFF")
    # Start the JVM's and the Python workers' first-use costs before the clock.
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total seconds of the registered queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
