"""Compare registered queries with their SQL on DuckDB.

``python -m tests.oracle [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _clean(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0 if STRICT else round(v, 5) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cleaned = [tuple(_clean(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(cleaned, key=lambda r: tuple((v is None, str(v)) for v in r))


STRICT = os.environ.get("STRICT") == "1"


def same(a, b) -> bool:
    if STRICT:
        return a == b and type(a) is type(b)
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1.5e-5 + 1e-9 * abs(a)
    return a == b and type(a) is type(b)


def compare(frame, con, sql):
    """Empty string when equal, else the first difference."""
    got_cols, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    rel = con.sql(sql)
    want_cols, want = rows_of(list(rel.columns), rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}", 0
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 50000 else []
        lack = [r for r in want if r not in set(got)][:2] if len(got) < 50000 else []
        return f"rows {len(got)} vs {len(want)} extra {extra} lack {lack}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if not all(same(x, y) for x, y in zip(g, w))]
    if bad:
        return f"{len(bad)}/{len(got)} differ, {got_cols}: {bad[0][0]} vs {bad[0][1]}", len(got)
    return "", len(got)


def main(argv):
    from gridloom.plans.registry import load_catalogue, oracle, run
    from gridloom.session import local_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    catalogue = load_catalogue()
    names = argv[1:] or list(catalogue)
    spark, con = local_session(), connect(folder)
    failed = 0
    for name in names:
        q = catalogue[name]
        start = time.time()
        try:
            frame = run(q, spark, folder)
            sql = oracle(q)
            if sql is None:
                verdict, n = "", frame.count()
                tag = "rows"
            else:
                verdict, n = compare(frame, con, sql)
                tag = "ok"
        except Exception as exc:  # report and go on with the other queries
            verdict, n, tag = f"{type(exc).__name__}: {str(exc)[:700]}", 0, "error"
        failed += bool(verdict)
        print(f"{'FAIL' if verdict else tag:5} {name:34} {n:8} {time.time() - start:6.1f}s {verdict}", flush=True)
    print(f"{len(names) - failed} good, {failed} bad")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
