"""Registered queries: one or more for each group of operators, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.column import spark as unwrap
from lakeloom.frame import Frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name, as frames; nothing is read before use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> Frame:
        return Frame(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))


def query(sql: str | None = None):
    """Register a function of :class:`Tables` as a query, with its SQL."""

    def register(function: Callable[[Tables], Frame | DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return unwrap(function(Tables(spark, sf_dir)))

        QUERIES[function.__name__] = run
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


from lakeloom.plans import function_batches, functions_queries, more_queries, relational, tpch  # noqa: E402,F401
