"""Compare registered queries with their SQL twins. ``python tests/oracle.py [folder] [names...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return f"{type(v).__name__}:{v}"


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(frame, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    cursor = con.execute(sql)
    want_names = [d[0] for d in cursor.description]
    want = rows_of(want_names, cursor.fetchall())
    got_names = frame.columns
    got = rows_of(got_names, frame.collect())
    if sorted(want_names) != sorted(got_names):
        return f"columns {sorted(got_names)} against {sorted(want_names)}"
    if want != got:
        extra, missing = got - want, want - got
        return (
            f"{sum(got.values())} rows against {sum(want.values())}; {sum(extra.values())} not expected, e.g. "
            f"{list(extra)[:3]}; {sum(missing.values())} missing, e.g. {list(missing)[:3]}"
        )
    if not want:
        return "both sides empty"
    return None


def main() -> int:
    from furrow.catalog import all_queries, all_sql
    from furrow.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    queries, sqls = all_queries(), all_sql()
    spark, con, bad = local_session(), duck(folder), 0
    for name, fn in queries.items():
        if wanted and name not in wanted:
            continue
        begin = time.time()
        try:
            frame = fn(spark, folder)
            problem = compare(frame, con, sqls[name]) if name in sqls else None
            rows = "" if name in sqls else f" {frame.count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            problem, rows = f"{type(e).__name__}: {str(e)[:1500]}", ""
        bad += problem is not None
        print(f"{'BAD' if problem else 'ok '} {name} {time.time() - begin:.1f}s{rows} {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
