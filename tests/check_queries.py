"""Run registered queries against DuckDB: python tests/check_queries.py [sf] [name part ...]."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from tests.compare import compare, duck
from versemill.session import local_session


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = duck(sf_dir)
    bad = []
    oracle = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            n, problems = compare(spark, con, fn, oracle.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            n, problems = -1, [traceback.format_exc(limit=-2)[-300:], str(e)[:900]]
        mark = "ok " if not problems else "BAD"
        if problems or n == 0:
            bad.append(name)
        print(f"{mark} {name} rows={n} {time.time() - t:.2f}s {'' if name in oracle else '(rows only)'}")
        for p in problems:
            print("     ", p[:1200])
    print("failed:", bad)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
