"""Compare registered queries with their SQL in DuckDB.

    python tests/oracle.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(glob.glob(f"{sf}/*.parquet")):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    con.execute("SET TimeZone='UTC'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def kind_spark(t: str) -> str:
    if t in ("int", "bigint", "smallint", "tinyint"):
        return "int"
    return {"double": "float", "float": "float", "string": "str", "boolean": "bool", "date": "date",
            "timestamp": "ts", "timestamp_ntz": "ts"}.get(t, t)


def kind_duck(t: str) -> str:
    t = str(t).upper()
    if t in ("INTEGER", "BIGINT", "SMALLINT", "TINYINT", "UBIGINT", "UINTEGER"):
        return "int"
    return {"DOUBLE": "float", "FLOAT": "float", "VARCHAR": "str", "BOOLEAN": "bool", "DATE": "date",
            "TIMESTAMP": "ts", "TIMESTAMP WITH TIME ZONE": "ts"}.get(t, t)


def key(row):
    return tuple((x is None, type(x).__name__, x) for x in row)


def compare(spark, con, q, sf: str) -> str:
    """Empty when equal, else what differs."""
    df = q.run(spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    rel = con.sql(q.sql)
    want_cols = sorted(rel.columns)
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    kinds = {c: kind_spark(t) for c, t in df.dtypes}
    want_kinds = {c: kind_duck(t) for c, t in zip(rel.columns, rel.types)}
    idx = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=key)
    if kinds != want_kinds:
        bad = {c: (kinds[c], want_kinds[c]) for c in kinds if kinds[c] != want_kinds[c]}
        return f"types {bad}"
    if len(got) != len(want):
        extra, missing = list(set(got) - set(want))[:3], list(set(want) - set(got))[:3]
        return f"rows {len(got)} != {len(want)}; cols {cols}; extra {extra}; missing {missing}"
    if not got:
        return "both empty"
    for a, b in zip(got, want):
        if a != b:
            return f"cols {cols}\n   spark {a}\n   duck  {b}"
    return ""


def main() -> None:
    from pyspark.sql import SparkSession

    from caseflow.plans import load_queries

    sf, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for q in load_queries().values():
        if names and not any(q.name == n or (n.endswith("*") and q.name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            if q.sql:
                why = compare(spark, con, q, sf)
            else:
                why = "" if q.run(spark, sf).count() > 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(why)
        print(f"{'FAIL' if why else 'ok  '} {q.name:32s} {time.time() - t:6.1f}s {'' if q.sql else '(rows)'} {why}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
