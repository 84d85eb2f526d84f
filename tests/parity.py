"""Run registered queries in Spark and their SQL in DuckDB and compare whole results.

``python tests/parity.py [--sf DIR] [name-part ...]``
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def family(name: str) -> str:
    n = name.lower()
    if n in ("tinyint", "smallint", "int", "integer", "bigint"):
        return n.replace("integer", "int")
    return {"varchar": "string", "boolean": "boolean", "double": "double"}.get(n, n)


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def key(row):
    return tuple((v is None, type(v).__name__, round(v, 4) if isinstance(v, float) else v) for v in row)


def compare(df, con, sql: str) -> tuple[str, int]:
    """'' when equal, else a description; and the row count."""
    cols = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}", -1
    st = {c: family(t) for c, t in df.dtypes}
    dt = {c: family(str(t)) for c, t in zip(rel.columns, rel.types)}
    bad_types = {c: (st[c], dt[c]) for c in cols if st[c] != dt[c]}
    left = [tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    order = [rel.columns.index(c) for c in cols]
    right = [tuple(norm(r[i]) for i in order) for r in rel.fetchall()]
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}", len(left)
    left.sort(key=key), right.sort(key=key)
    off = [(a, b) for a, b in zip(left, right) if a != b]
    if off:
        far = [
            (a, b) for a, b in off
            if any(
                x != y and not (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6))
                for x, y in zip(a, b)
            )
        ]
        kind = "DIFFER" if far else "last-digit"
        a, b = (far or off)[0]
        return f"{kind}: {len(far)}/{len(off)} of {len(left)} rows; cols {cols}\n   spark {a}\n   duck  {b}", len(left)
    if any("nan" in r for r in left):
        return "NaN in result", len(left)
    if bad_types:
        return f"types {bad_types}", len(left)
    return "", len(left)


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from arborstat.session import local_session

    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i : i + 2]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    fails = 0
    for name, fn in qs.items():
        if argv and not any(a in name for a in argv):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                msg, n = compare(df, con, sqls[name])
            else:
                n, msg = df.count(), ""
        except Exception as e:  # report and go on with the next query
            msg, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        fails += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {name} rows={n} {time.time() - t0:.1f}s {'' if name in sqls else '(rows only)'} {msg}", flush=True)
    print(f"{fails} failing")
    return fails


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
