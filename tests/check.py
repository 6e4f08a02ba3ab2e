"""Run registered queries against DuckDB: python tests/check.py [sf] [name-substring ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    import __spark_entry__ as entry
    from vellum.session import build_session

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    picks = sys.argv[2:]
    spark = build_session("local[8]", 8, spark__driver__memory="16g", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if picks and not any(p in name for p in picks):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                ok, msg, n = compare(df, con, sqls[name])
            else:
                n = len(df.collect())
                ok, msg = n > 0, "rows only"
        except Exception as exc:  # report and go on to the next query
            ok, msg, n = False, f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - t0:6.2f}s {n:7d} {name} {msg}", flush=True)
        if n == 0:
            print(f"     empty: {name}")
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
