"""Registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scenelake.plans.tables import Catalog, duckdb_sql, open_catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, ctes: dict[str, str] | None = None):
    """Register `fn(catalog) -> DataFrame` under `name`, with the SELECT DuckDB checks it against."""

    def register(fn: Callable[[Catalog], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(open_catalog(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = duckdb_sql(oracle.strip(), ctes)
        return fn

    return register
