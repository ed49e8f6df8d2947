"""Run registered queries against their SQL in DuckDB: python check.py [sf or folder] [name ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from faultline.catalog import ORACLES, QUERIES
from faultline.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, bool) or value is None:
            return repr(value)
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(float(f"{value:.9g}"))
        return f"{type(value).__name__}:{value}"

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, db, name: str, sf_dir: str) -> str | None:
    """None when equal, else a short description of the difference."""
    frame = QUERIES[name](spark, sf_dir)
    got = canonical(frame.columns, frame.collect())
    if name not in ORACLES:
        return None if got else "no rows"
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = canonical(columns, cursor.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} vs {sorted(columns)}"
    if got == want:
        return None if got else "equal but empty"
    extra, missing = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} rows vs {len(want)}; only here {sorted(extra)[:3]}; only there {sorted(missing)[:3]}"


def main() -> int:
    args = sys.argv[1:]
    where = args.pop(0) if args and args[0].startswith(("sf", "/")) else "sf0.01"
    sf_dir = where if where.startswith("/") else f"/root/testdata/{where}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    failed = 0
    for name in args or list(QUERIES):
        begun = time.time()
        try:
            problem = compare(spark, db, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        kind = "" if name in ORACLES else " (rows only)"
        print(f"{mark} {name} {time.time() - begun:.1f}s{kind} {problem or ''}", flush=True)
    print(f"{failed} failed", flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
