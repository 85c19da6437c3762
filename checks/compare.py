"""Run the registered queries and their SQL twins side by side: python -m checks.compare [sf_dir] [name...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _sortable(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)) if v is None else "", v if v is not None else 0) for v in row)


def difference(spark, con, name: str, sf_dir: str) -> str | None:
    """None if both sides give the same rows, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*cols).collect()), key=_sortable)
    if name not in ORACLE:
        return None if rows else "no rows"
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    if sorted(names) != cols:
        return f"columns differ: {sorted(set(names) ^ set(cols))}"
    place = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in place) for r in cur.fetchall()), key=_sortable)
    if len(rows) != len(want):
        return f"{len(rows)} rows, expected {len(want)}; only ours {list(set(rows) - set(want))[:2]}, only SQL {list(set(want) - set(rows))[:2]}"
    close = 0
    for a, b in zip(rows, want):
        for c, u, v in zip(cols, a, b):
            if u != v:
                if isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, abs_tol=2e-6):
                    close += 1
                else:
                    return f"{c}: {u!r} != {v!r} in {a} / {b}"
    return f"{close} values differ in the last place" if close else None


def main() -> None:
    from siterank.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            bad = difference(spark, con, name, sf_dir)
        except Exception as e:  # a broken query must not hide the others
            bad = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if bad is None else 'FAIL'} {name} {time.time() - start:.1f}s {bad or ''}", flush=True)


if __name__ == "__main__":
    main()
