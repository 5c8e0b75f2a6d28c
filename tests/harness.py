"""Compare a registered query with its SQL on one scale folder."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


TIMES = {"spark": 0.0, "sql": 0.0}


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return names, sorted(out, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty string when equal, else what differs."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    begin = time.time()
    got_cols, got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    TIMES["spark"] = time.time() - begin
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows and no SQL"
    begin = time.time()
    rel = con.execute(sql)
    want_cols, want = _sorted_rows([d[0] for d in rel.description], rel.fetchall())
    TIMES["sql"] = time.time() - begin
    if got_cols != want_cols:
        return f"columns {got_cols} <> {want_cols}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"rows {len(got)} <> {len(want)} extra {extra} missing {missing}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} rows differ: {got_cols} {bad[:3]}"
    return "" if got else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pagewarden.session import build_session

    folder = "/root/testdata/sf0.01"
    session = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g", "spark.log.level": "ERROR"},
    )
    connection = connect(folder)
    picked = sys.argv[1:]
    failed = 0
    for key in entry.queries():
        if picked and not any(key.startswith(p) for p in picked):
            continue
        begin = time.time()
        try:
            result = compare(session, connection, key, folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(result)
        mark = "ok " if not result else "BAD"
        sql = "" if key in entry.oracle_sql() else " (no sql)"
        print(f"{mark} {key} {TIMES['spark']:.1f}/{TIMES['sql']:.1f}s{sql} {result[:1800]}", flush=True)
    print("failed", failed)
