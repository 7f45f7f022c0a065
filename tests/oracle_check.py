"""Run registered queries on one scale directory and compare with their oracle SQL in DuckDB.

usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def last_place(x):
    """Size of the last decimal that a rounded value shows."""
    text = repr(float(x))
    return 10.0 ** -len(text.partition(".")[2]) if "e" not in text and "n" not in text else 0.0


def close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        # equal to 1e-9, or one step of the last printed digit (a tie rounds either way)
        return abs(a - b) <= max(1e-9 * max(1.0, abs(a), abs(b)), 1.01 * min(last_place(a), last_place(b)))
    return a == b


def compare(spark_df, con, sql):
    got_names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_names, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns differ: spark={got_names} oracle={want_names}"
    if len(got) != len(want):
        return f"row counts differ: spark={len(got)} oracle={len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        soft = all(all(close(a, b) for a, b in zip(g, w)) for g, w in bad)
        types = {(n, type(a).__name__, type(b).__name__) for g, w in bad for n, a, b in zip(got_names, g, w) if type(a) is not type(b)}
        return f"{'ROUNDING' if soft else 'VALUES'} {len(bad)}/{len(got)} rows differ; types={types}\n   spark ={bad[0][0]}\n   oracle={bad[0][1]}"
    loose = {(n, type(a).__name__, type(b).__name__) for g, w in zip(got, want) for n, a, b in zip(got_names, g, w) if type(a) is not type(b)}
    if loose:
        return f"types differ: {loose}"
    return None


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    import __spark_entry__ as entry

    from trialweave.runtime import build_session

    spark = build_session(os.environ.get("CHECK_CPUS", "8"), shuffle_partitions=8)
    con = duck(sf)
    oracles = entry.oracle_sql()
    fails = 0
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            if name in oracles:
                msg = compare(fn(spark, sf), con, oracles[name])
                label = "ok"
            else:
                n = len(fn(spark, sf).collect())
                msg, label = None, f"rows={n}"
        except Exception as e:  # report every failing query, not only the first
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        fails += msg is not None
        print(f"{name:34s} {time.time() - t:6.2f}s  {'FAIL ' + msg if msg else label}", flush=True)
    print("failures:", fails)


if __name__ == "__main__":
    main()
