"""Run a registered job on Spark and its SQL on DuckDB, and compare the sorted rows by value."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v if v is None else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple("" if x is None else x for x in r))


def compare(spark, con, job, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = job.run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    sql = job.oracle()
    if sql is None:
        return True, f"rows={len(got[1])} (no oracle) {t1 - t0:.1f}s"
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    note = f"rows={len(got[1])} spark={t1 - t0:.1f}s duckdb={t2 - t1:.1f}s"
    if got == want:
        return True, note
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    a, b = set(got[1]), set(want[1])
    return False, (f"{note} want_rows={len(want[1])} only_spark={sorted(a - b, key=str)[:3]} ({len(a - b)}) "
                   f"only_sql={sorted(b - a, key=str)[:3]} ({len(b - a)})")


def local_spark(cpus: int = 8):
    from gridspark.session import get_session
    spark = get_session("gridspark-check", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    from gridspark.catalog.all_jobs import JOBS
    sf = argv[0]
    want = argv[1:]
    spark, con = local_spark(), duck(sf)
    bad = 0
    for key, job in JOBS.items():
        if want and not any(key.startswith(w) for w in want):
            continue
        try:
            ok, note = compare(spark, con, job, sf)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", key, note, flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
