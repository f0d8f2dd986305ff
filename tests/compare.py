"""Run a registered query on Spark and its SQL on DuckDB and compare the rows.

    python tests/compare.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "item"):
        return _plain(value.item())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, int):
        return value
    return str(value)


def _kind(value) -> str:
    return {bool: "bool", int: "int", float: "float", str: "str", tuple: "list"}.get(
        type(value), "null")


def rows_of(names: list[str], rows) -> tuple[list[str], Counter, dict]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out, kinds = Counter(), {}
    for r in rows:
        values = tuple(_plain(r[i]) for i in order)
        for i, v in zip(order, values):
            if v is not None:
                kinds.setdefault(names[i], _kind(v))
        out[values] += 1
    return [names[i] for i in order], out, kinds


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[bool, str]:
    names, got, gk = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    wnames, want, wk = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != wnames:
        return False, f"columns {names} != {wnames}"
    differ = {c: (gk[c], wk[c]) for c in gk if c in wk and gk[c] != wk[c]}
    if differ:
        return False, f"types {differ}"
    if got != want:
        extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
        return False, (f"{sum(got.values())} rows vs {sum(want.values())}; only spark "
                       f"{sum((got - want).values())}: {extra}; only sql "
                       f"{sum((want - got).values())}: {missing}")
    return True, f"{sum(got.values())} rows"


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in oracle:
                ok, note = compare(fn(spark, sf_dir), con, oracle[name])
            else:
                ok, note = True, f"{fn(spark, sf_dir).count()} rows, no SQL"
        except Exception as err:  # noqa: BLE001
            ok, note = False, f"{type(err).__name__}: {str(err)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, f"{time.time() - start:.1f}s", note, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
