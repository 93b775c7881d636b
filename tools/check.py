"""Compare queries with their SQL: `python tools/check.py SF_DIR [name ...]`."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(table):
    """Rows with columns by name, values made comparable, in a fixed order."""
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    fix = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v
    return names, sorted((tuple(map(fix, r)) for r in zip(*cols)), key=repr)


def compare(spark, con, query, sql, sf):
    t0 = time.time()
    left = query(spark, sf).toArrow()
    t1 = time.time()
    right = con.execute(sql).to_arrow_table()
    t2 = time.time()
    ln, lr = rows(left)
    rn, rr = rows(right)
    if ln != rn:
        return f"columns {sorted(set(ln) ^ set(rn))}", t1 - t0, t2 - t1, len(lr)
    if lr != rr:
        a = [x for x in lr if x not in set(rr)][:2] if len(lr) < 200000 else lr[:1]
        b = [x for x in rr if x not in set(lr)][:2] if len(rr) < 200000 else rr[:1]
        return f"rows {len(lr)} vs {len(rr)} {ln}\n   spark {str(a)[:700]}\n   sql   {str(b)[:700]}", t1 - t0, t2 - t1, len(lr)
    return "", t1 - t0, t2 - t1, len(lr)


if __name__ == "__main__":
    from voxlake.plans.oracle import ORACLE
    from voxlake.plans.registry import QUERIES
    from voxlake.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), database(sf)
    bad = []
    for name in names or QUERIES:
        if name not in ORACLE:
            print(f"{name:30s} no SQL", flush=True)
            continue
        try:
            verdict, a, b, n = compare(spark, con, QUERIES[name], ORACLE[name], sf)
        except Exception as e:
            verdict, a, b, n = f"{type(e).__name__} {str(e)[:600]}", 0, 0, 0
        print(f"{name:30s} {'ok' if not verdict else 'DIFFERS ' + verdict} ({n} rows, spark {a:.1f}s, sql {b:.1f}s)", flush=True)
        if verdict:
            bad.append(name)
    print("failed:", len(bad), *bad)
