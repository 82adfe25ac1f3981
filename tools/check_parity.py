"""Run named queries against their DuckDB oracle and report differences.

    python tools/check_parity.py [--sf DIR] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from topicpulse.plans.registry import catalogue  # noqa: E402
from topicpulse.session import local_session  # noqa: E402


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9) + 0.0)
    if isinstance(v, bool) or v is None:
        return repr(v)
    return str(v)


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


_KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE",
}


def compare(spark, con, q, folder):
    started = time.time()
    df = q(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if q.oracle is None:
        return took, len(rows), None
    cur = con.execute(q.oracle)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    expected = cur.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return took, len(rows), f"columns {sorted(df.columns)} vs {sorted(names)}"
    kinds = dict(zip(names, types))
    for name, kind in df.dtypes:
        if _KIND.get(kind, kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} vs {kinds[name]}")
    got, want = normal(rows, df.columns), normal(expected, names)
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        problems.append(f"rows {len(got)} vs {len(want)}; only spark {str(extra)[:900]}; only oracle {str(missing)[:900]}")
    if not rows:
        problems.append("no rows")
    return took, len(rows), "; ".join(problems) or None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    bad = 0
    for name, q in catalogue().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            took, n, problem = compare(spark, con, q, args.sf)
        except Exception as e:  # noqa: BLE001
            took, n, problem = 0.0, 0, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '}{name:36s} {took:6.2f}s rows={n} {'' if q.oracle else '(no oracle)'} {problem or ''}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
