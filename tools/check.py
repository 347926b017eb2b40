"""Run registered queries next to their SQL in DuckDB and compare columns, types and rows.

    python tools/check.py [--sf /root/testdata/sf0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import tempfile
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from hazegrid.plans.catalog import ORACLES, QUERIES  # noqa: E402
from hazegrid.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
         "DATE": "date", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cur = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in cur.description}
    rows = cur.fetchall()
    names = sorted(theirs)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} != {names}"
    ours = dict(df.dtypes)
    for n in names:
        if TYPES.get(theirs[n], theirs[n]) != ours[n]:
            return f"type of {n}: {ours[n]} != {theirs[n]}"
    place = [list(theirs).index(n) for n in names]
    b = Counter(tuple(repr(r[i]) for i in place) for r in rows)
    a = Counter(tuple(repr(r[n]) for n in names) for r in df.collect())
    if a == b:
        return None
    return f"{sum(a.values())} rows vs {sum(b.values())}; only ours {list((a - b).items())[:3]}; only sql {list((b - a).items())[:3]}"


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("names", nargs="*")
    args = p.parse_args()
    shared = tempfile.TemporaryDirectory(prefix="check-")
    spark = local_session(**{"spark.checkpoint.dir": shared.name})
    con, bad, unchecked = duck(args.sf), 0, 0
    for name, run in QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        begun = time.time()
        try:
            df = run(spark, args.sf)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
            else:
                n, problem = len(df.collect()), None
                unchecked += 1
                problem = "no rows" if n == 0 else None
        except Exception as err:  # report and go on with the next query
            problem = f"{type(err).__name__}: {str(err)[:600]}"
        bad += problem is not None
        mark = "FAIL" if problem else ("ok  " if name in ORACLES else "rows")
        print(f"{mark} {time.time() - begun:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} failed, {unchecked} without SQL")
    spark.stop()
    shared.cleanup()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
