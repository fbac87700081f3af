"""Run named queries on Spark and their SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import glob
import logging
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f'CREATE VIEW "{name}" AS SELECT * FROM \'{path}\'')
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(v) + 0.0
    if type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, key, entry, folder, con=None):
    """Returns (ok, detail)."""
    t0 = time.time()
    df = entry.run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if entry.sql is None:
        return False, f"no SQL to compare with: {len(got)} rows, spark {t1 - t0:.1f}s"
    con = con or connect(folder)
    res = con.execute(entry.sql)
    cols = [c[0] for c in res.description]
    kinds = [str(c[1]) for c in res.description]
    want = res.fetchall()
    t2 = time.time()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    note = f"{len(a)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if len(a) != len(b):
        return False, f"{len(a)} vs {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} of {len(a)} differ, columns {sorted(cols)}: spark {bad[0][0]} sql {bad[0][1]}"
    types = dict(df.dtypes)
    simple = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    off = [f"{c}:{types[c]}/{k}" for c, k in zip(cols, kinds) if simple.get(k, k) != types[c]]
    if off:
        note += " TYPES " + " ".join(off)
    return True, note


if __name__ == "__main__":
    from replenish.plans.catalog import REGISTRY
    from replenish.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(
        master=os.environ.get("HARNESS_MASTER", "local[8]"),
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
           "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"},
    )
    spark.sparkContext.setLogLevel("OFF")
    logging.disable(logging.CRITICAL)
    con = connect(folder)
    bad = 0
    for key, entry in REGISTRY.items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        try:
            ok, detail = compare(spark, key, entry, folder, con)
        except Exception as e:  # noqa: BLE001
            ok, detail = False, f"{type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print("ok " if ok else "BAD", key, detail, flush=True)
    print("failed:", bad)
