"""Wall time of the registered queries of the reference's operators, as one JSON line.

Besides the total of each query (the faster run), ``plan`` is the part spent on building and
optimising the plan, opening tables and measuring dimensions, and ``run`` the rest.

BENCH_SF_DIR   table directory (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default: all)
BENCH_QUERIES  comma-separated query names (default: all)
BENCH_RUNS     timed runs per query; the fastest counts (default 2)
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame

from seasonstar.plans.queries import QUERIES
from seasonstar.session import local_session

def run(frame: DataFrame) -> None:
    """Compute every row and column without keeping or collecting them."""
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = wanted.split(",") if wanted and wanted != "all" else list(QUERIES)
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    first, best, plans, rest = {}, {}, {}, {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            frame = QUERIES[name](spark, sf_dir)
            frame._jdf.queryExecution().executedPlan()
            built = time.perf_counter()
            run(frame)
            end = time.perf_counter()
            times.append((end - start, built - start, end - built))
        first[name] = round(times[0][0], 3)
        best[name], plans[name], rest[name] = (round(x, 3) for x in min(times))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds, all queries",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "first_run": first,
                "plan": plans,
                "run": rest,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
