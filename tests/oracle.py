"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    con.execute("SET TimeZone='UTC'")
    return con


def _norm(v):
    if v is None:
        return "\0null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}"
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    """Return (ok, message, row_count)."""
    got = spark_df.collect()
    c1, r1 = rows_of(spark_df.columns, got)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    c2, r2 = rows_of(names, cur.fetchall())
    if c1 != c2:
        return False, f"columns {c1} vs {c2}", len(r1)
    if r1 != r2:
        s1, s2 = set(r1), set(r2)
        return False, (f"rows {len(r1)} vs {len(r2)}; only spark {list(s1 - s2)[:2]}; "
                       f"only sql {list(s2 - s1)[:2]}"), len(r1)
    want = {"long": "BIGINT", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
    odd = [f"{n}:{t}/{types[n]}" for n, t in spark_df.dtypes
           if want.get(t) != types[n].replace("TIMESTAMP WITH TIME ZONE", "TIMESTAMP")]
    return True, ("types " + ",".join(odd)) if odd else "", len(r1)
