"""Run registered queries against their check SQL in DuckDB: ``python -m tests.compare DIR [NAME-PREFIX...]``."""

from __future__ import annotations

import datetime
import glob
import os
import sys
import time


def views(base: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{base}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if isinstance(v, float) and v == int(v) and abs(v) < 2**53:
        return int(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return int(v) if v == int(v) else round(float(v), 6)
    return v


def compare(spark, con, fn, sql, base) -> str:
    df = fn(spark, base)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in (x.asDict(True) for x in df.collect())), key=repr)
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != names:
        return f"columns {names} and {sorted(cols)}"
    want = sorted((tuple(plain(dict(zip(cols, r, strict=True))[n]) for n in names) for r in cur.fetchall()), key=repr)
    if got == want:
        return "ok" if got else "ok, empty"
    extra, lacking = [r for r in got if r not in want][:3], [r for r in want if r not in got][:3]
    return f"{len(got)} and {len(want)} rows; only here {extra}; only there {lacking}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = views(sys.argv[1])
    qs, sql = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        t = time.time()
        try:
            if name in sql:
                said = compare(spark, con, fn, sql[name], sys.argv[1])
            else:
                said = f"rows {fn(spark, sys.argv[1]).count()}"
        except Exception as e:
            said = f"ERROR {str(e)[:1500]}"
        good = said.startswith(("ok", "rows"))
        bad += not good
        print(f"{name:32s} {time.time() - t:6.1f}s {'' if good else '**** '}{said}", flush=True)
    print("bad:", bad)
