"""Run queries in Spark and their SQL in DuckDB and compare: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v: object) -> object:
    if v is None or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, pd.Timestamp):
        return str(v)[:10] if str(v).endswith("00:00:00") else str(v)
    if hasattr(v, "isoformat"):
        text = v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
        return text[:10] if text.endswith("00:00:00") else text
    return v


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty where both results are the same, else what differs."""
    got = _rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(bad)} of {len(want)} rows differ, e.g. {str(bad[0][0])[:300]} | {str(bad[0][1])[:300]}" if bad else ""


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    missing = set(sql) - set(queries)
    print("oracle without query:", missing)
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sql:
                verdict = compare(df, con, sql[name]) or "ok"
            else:
                verdict = f"no oracle, {len(df.collect())} rows"
        except Exception as e:  # noqa: BLE001
            verdict = "ERROR " + str(e)[:600]
        print(f"{name:34s} {time.time() - t:6.2f}s {verdict}", flush=True)


if __name__ == "__main__":
    main()
