"""Holds registered queries against their SQL in DuckDB: python tests/compare.py SF_DIR [NAME ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return int(x)
    if hasattr(x, "item"):
        x = x.item()
    return x


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[names].itertuples(index=False, name=None)), key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) if not isinstance(v, float) else (True, "f", round(v, 3)) for v in r))


def same(a, b) -> bool:
    if a is None or b is None or isinstance(a, str) or isinstance(b, str):
        return a == b
    return abs(a - b) <= 1e-9 + 1e-12 * abs(b) if isinstance(a, (int, float)) and isinstance(b, (int, float)) else str(a) == str(b)


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def differences(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    ours, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    a, b = rows_of(ours.astype(object)), rows_of(theirs.astype(object))
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))]
    return f"{len(bad)} of {len(a)} rows differ, such as {bad[0]}" if bad else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, con = entry.queries(), entry.oracle_sql(), database(sys.argv[1])
    for name in sys.argv[2:] or [q for q in queries if not q.startswith("op") and q != "pipeline"]:
        t = time.time()
        try:
            said = differences(spark, con, name, queries[name], sql[name], sys.argv[1]) if name in sql else f"{queries[name](spark, sys.argv[1]).count()} rows, no SQL"
        except Exception as e:
            said = f"FAILED {str(e)[:600]}"
        print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)
