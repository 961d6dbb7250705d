"""Compares a Spark query with its DuckDB oracle."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(repr, t))
    )


SPARK_KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def compare(df, con, sql) -> list[str]:
    """Differences between the two results; empty when they agree."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {r[0]: r[1] for r in con.execute("describe " + sql).fetchall()}
    duck = _rows(names, con.execute(sql).fetchall())
    spark = _rows(df.columns, [tuple(r) for r in df.collect()])
    out = []
    if sorted(names) != sorted(df.columns):
        out.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
    for name, kind in df.dtypes:
        if kinds.get(name) != SPARK_KIND.get(kind, kind):
            out.append(f"type of {name}: {kind} vs {kinds.get(name)}")
    if len(duck) != len(spark):
        out.append(f"rows {len(spark)} vs {len(duck)}")
    diff = [(a, b) for a, b in zip(spark, duck) if a != b]
    if diff:
        only_spark = [r for r in spark if r not in set(duck)][:2]
        only_duck = [r for r in duck if r not in set(spark)][:2]
        out.append(f"{len(diff)} values differ; spark {str(only_spark)[:600]} duck {str(only_duck)[:600]}")
    if not spark:
        out.append("EMPTY")
    return out
