"""Single-node reference point: the oracle SQL of every query run by DuckDB.

The original tool executes its SQL in an in-process
DuckDB database; timing the same statements here (same Parquet tables, same
machine) gives the comparison the published documentation does not.
Prints one JSON line like bench.py (median of 3 after one warm-up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerops.plans import ORACLE  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    threads = int(os.environ.get("BENCH_CPUS", "8"))
    con = duckdb.connect()
    con.execute(f"SET threads = {threads}")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    timings = {}
    for name, sql in ORACLE.items():  # the ledger queries
        runs = []
        for i in range(4):
            start = time.perf_counter()
            con.execute(sql).fetchall()
            if i:
                runs.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(runs), 4)
    print(json.dumps({"metric": "duckdb oracle, sum of per-query median wall seconds",
                      "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                      "sf": sf_dir, "threads": threads, "duckdb": duckdb.__version__}))


if __name__ == "__main__":
    main()
