"""Runs registered queries next to their SQL and compares the results exactly.

    python tests/oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        col = frame[name]
        if pd.api.types.is_datetime64_any_dtype(col):
            frame[name] = col.dt.strftime("%Y-%m-%d")
        elif not pd.api.types.is_numeric_dtype(col):
            frame[name] = col.map(lambda x: None if x is None or x != x else str(x)[:10] if hasattr(x, "year") else x)
    return frame.sort_values(list(frame.columns), kind="stable", na_position="first").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = _normal(got), _normal(want)
    for name in a.columns:
        x, y = a[name], b[name]
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{name}: {(~same).sum()} values, first {x[i]!r} != {y[i]!r} in {a.loc[i].to_dict()}"
    return None


def types_differ(spark_df, want) -> list[str]:
    """Columns whose Spark and SQL types are of different kinds."""
    kinds = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
        "float": "FLOAT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "tinyint": "TINYINT",
    }
    sql = dict(want)
    return [
        f"{f.name} {f.dataType.simpleString()} != {sql.get(f.name)}"
        for f in spark_df.schema.fields
        if kinds.get(f.dataType.simpleString().replace("_ntz", "")) != sql.get(f.name)
    ]


def main() -> int:
    from demandgrid.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = contract.oracle_sql()
    failed = 0
    for name, run in contract.queries().items():
        if args and not any(name.startswith(p) for p in args):
            continue
        begin = time.time()
        try:
            df = run(spark, sf_dir)
            got = df.toPandas()
            spent = time.time() - begin
            if name not in sqls:
                print(f"ok    {name} rows={len(got)} spark={spent:.2f}s (rows only)", flush=True)
                continue
            begin = time.time()
            want = con.execute(sqls[name]).fetchdf()
            described = [(r[0], r[1]) for r in con.execute(f"DESCRIBE {sqls[name]}").fetchall()]
            problem = difference(got, want) or "; ".join(types_differ(df, described)) or None
            word = "ok   " if problem is None else "FAIL "
            failed += problem is not None
            print(f"{word} {name} rows={len(got)} spark={spent:.2f}s sql={time.time() - begin:.2f}s {problem or ''}", flush=True)
        except Exception as e:  # report every query
            failed += 1
            print(f"ERROR {name} {type(e).__name__}: {str(e)[:600]}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
