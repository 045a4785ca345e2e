"""Queries by name, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.plans.binding import Graph, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of a Graph under a name, with SQL over the tables and views of the binding."""

    def add(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Graph(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = run
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add
