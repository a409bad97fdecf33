"""Benchmark: run every registered query on ``$BENCH_SF_DIR`` and print one JSON line.

Each query is executed to completion with the ``noop`` sink (all rows are
produced, nothing is collected), once to warm up and then ``$BENCH_RUNS``
times (default 3); the median is reported.  ``value`` is the sum of the
medians.  The matching DuckDB oracle SQL is timed the same way on the same
files (``duckdb`` map) as the single-node reference point.

Streams (``*_stream``) run micro batches through a state store; they are timed
only when named.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all
cores), BENCH_RUNS (default 3), BENCH_QUERIES (comma list, default all but streams),
BENCH_DUCKDB (1/0, default 1).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    with_duck = os.environ.get("BENCH_DUCKDB", "1") == "1"

    from orrery.plans import catalog
    from orrery.session import local_session

    catalog.load_all()
    spark = local_session(cores=cpus, shuffle_partitions=max(2 * cpus, 8), app="orrery-bench",
                          checkpoint=tempfile.mkdtemp(prefix="orrery-bench-ckpt-"))

    names = [n for n in catalog.QUERIES if (n in only if only else not n.endswith("_stream"))]
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        fn = catalog.QUERIES[name]
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            ts = []
            for _ in range(runs):
                t0 = time.perf_counter()
                fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
                ts.append(time.perf_counter() - t0)
            times[name] = round(statistics.median(ts), 4)
        except Exception as e:  # noqa: BLE001 - report and continue
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"

    duck: dict[str, float] = {}
    if with_duck:
        try:
            import duckdb

            from orrery.sources.tables import DRIVER_TABLES

            con = duckdb.connect()
            con.execute(f"SET threads = {cpus}")
            for t in DRIVER_TABLES:
                p = os.path.join(sf_dir, f"{t}.parquet")
                if os.path.exists(p):
                    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
            for name in names:
                sql = catalog.ORACLES.get(name)
                if sql is None:
                    continue
                try:
                    con.execute(sql).fetchall()
                    ts = []
                    for _ in range(runs):
                        t0 = time.perf_counter()
                        con.execute(sql).fetchall()
                        ts.append(time.perf_counter() - t0)
                    duck[name] = round(statistics.median(ts), 4)
                except Exception:  # noqa: BLE001
                    pass
        except ImportError:
            pass

    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
        "headline": {n: times[n] for n in catalog.HEADLINE if n in times},
        "duckdb": duck,
        "errors": errors,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
