"""The query catalogue: one entry per operator, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stationproof.plans import oracle, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is its DuckDB twin over the shared expressions."""

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            views.prepare(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = oracle.sql(sql)
        return fn

    return wrap
