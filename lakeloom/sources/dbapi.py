"""Partitioned reads through DB-API connections."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def bounds_predicates(column: str, lower: Any, upper: Any, parts: int) -> list[str]:
    """Ranges of a numeric, date or time column; the first and last are open, and the first takes nulls."""
    if lower is None or upper is None:
        raise ValueError("bounds are needed with a partition column")
    if isinstance(lower, str):
        lower, upper = (datetime.datetime.fromisoformat(x) for x in (lower, upper))
    if lower > upper:
        raise ValueError("the lower bound is above the upper one")
    step = (upper - lower) / parts
    whole = isinstance(lower, int) and isinstance(upper, int)
    parts = max(1, min(parts, upper - lower)) if whole else parts
    if parts <= 1:
        return ["1 = 1"]
    show = lambda v: f"'{v}'" if isinstance(v, (datetime.date, datetime.datetime)) else str(v)
    cuts = [lower + (int((upper - lower) * i / parts) if whole else step * i) for i in range(1, parts)]
    out = [f"{column} < {show(cuts[0])} OR {column} IS NULL"]
    out += [f"{column} >= {show(a)} AND {column} < {show(b)}" for a, b in zip(cuts, cuts[1:])]
    return [*out, f"{column} >= {show(cuts[-1])}"]


def infer(connect: Callable, statement: str) -> str:
    """A schema in DDL from the first rows of a query."""
    connection = connect()
    try:
        cursor = connection.cursor()
        cursor.execute(statement)
        rows = cursor.fetchmany(200)
        names = [d[0] for d in cursor.description]
    finally:
        connection.close()
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string", bytes: "binary", datetime.date: "date", datetime.datetime: "timestamp", decimal.Decimal: "decimal(38,10)"}
    columns = []
    for i, name in enumerate(names):
        found = {kinds.get(type(r[i]), "string") for r in rows if r[i] is not None}
        columns.append(f"`{name}` {found.pop() if len(found) == 1 else 'double' if found == {'bigint', 'double'} else 'string'}")
    return ", ".join(columns)


def read_dbapi(session: SparkSession, connect: Callable, table: str | None, query: str | None, predicates: list[str] | None, schema: Any, fetch_size: int, init: Any) -> DataFrame:
    """One task for each predicate; rows stream through in batches of ``fetch_size``."""
    source = table or f"({query}) q"
    schema = schema or infer(connect, f"SELECT * FROM {source}")
    parts = predicates or ["1 = 1"]
    inits = [init] if isinstance(init, str) else list(init or [])
    tasks = session.createDataFrame([(i, p) for i, p in enumerate(parts)], "n int, predicate string").repartition(len(parts), "n")
    names = [f.name for f in session.createDataFrame([], schema).schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for predicate in batch["predicate"]:
                connection = connect()
                try:
                    cursor = connection.cursor()
                    for statement in inits:
                        cursor.execute(statement)
                    cursor.execute(f"SELECT * FROM {source} WHERE {predicate}")
                    while rows := cursor.fetchmany(fetch_size):
                        yield pd.DataFrame([tuple(r) for r in rows], columns=names, dtype=object)
                finally:
                    connection.close()

    return tasks.mapInPandas(run, schema)
