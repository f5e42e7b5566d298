"""Grouped frames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom import functions as L
from lakeloom.column import Col, named, spark


def aggregate_expressions(exprs: tuple) -> list:
    """Aggregates in any of their forms: columns, (column, name) tuples, dicts, lists of those."""
    out = []
    for e in exprs:
        if isinstance(e, dict):
            out += [_named_aggregate(c, f) for c, f in e.items()]
        elif isinstance(e, tuple) and len(e) == 2 and isinstance(e[1], str):
            out.append(_named_aggregate(*e))
        elif isinstance(e, (list, tuple)):
            out += aggregate_expressions(tuple(e))
        else:
            out.append(spark(e))
    return out


def _named_aggregate(column: Any, name: str):
    label = column if isinstance(column, str) else column.get_name() or "expr"
    return getattr(L, name.lower())(column).c.alias(f"{name.upper()}({label})")


class Grouped:
    """Rows by group; ``pivot`` turns a column's values into columns of the result."""

    def __init__(self, frame: DataFrame, keys: list, kind: str = "groupBy", sets: list[list] | None = None, pivoted: tuple | None = None):
        self.frame, self.keys, self.kind, self.sets, self.pivoted = frame, keys, kind, sets, pivoted

    def _grouped(self):
        if self.kind == "groupingSets":
            return self.frame.groupingSets(self.sets, *self.keys)
        grouped = getattr(self.frame, self.kind)(*self.keys)
        if self.pivoted:
            column, values = self.pivoted[:2]
            grouped = grouped.pivot(column, values)
        return grouped

    def agg(self, *exprs: Any):
        from lakeloom.frame import Frame

        expressions = aggregate_expressions(exprs)
        out = self._grouped().agg(*expressions) if expressions else self.frame.select(*self.keys).distinct()
        if self.pivoted and self.pivoted[2] is not None:
            keys = set(self.frame.select(*self.keys).columns) if self.keys else set()
            out = out.select(*[c if c in keys else F.coalesce(F.col(f"`{c}`"), F.lit(self.pivoted[2])).alias(c) for c in out.columns])
        return Frame(out)

    def pivot(self, column: Any, values: Any = None, default_on_null: Any = None) -> Grouped:
        """Values may be a list, a frame of one column, or None for all that occur."""
        from lakeloom.frame import Frame

        if isinstance(values, Frame):
            values = [r[0] for r in values._spark_object.distinct().collect()]
        if values is not None and not isinstance(values, (list, tuple)):
            values = [values]
        name = column if isinstance(column, str) else column.get_name()
        return Grouped(self.frame, self.keys, self.kind, self.sets, (name, list(values) if values is not None else None, default_on_null))

    def _numeric(self, function: str, columns: tuple):
        if not columns:
            raise ValueError("name at least one column")
        return self.agg(*[(c, function) for c in columns])

    def count(self):
        return self.agg(Col(F.count(F.lit(1)).alias("COUNT")))

    def function(self, name: str):
        return lambda *columns: self._numeric(name, columns)

    builtin = function

    def apply_in_pandas(self, func: Any, output_schema: Any, **_: Any):
        """One pandas frame in and out for each group; a group must fit a worker's memory."""
        from lakeloom.frame import Frame

        return Frame(self._grouped().applyInPandas(func, output_schema))

    applyInPandas = apply_in_pandas

    def ai_agg(self, expr: Any, task_description: str):
        return self.agg(L.ai_agg(expr, task_description).alias("AI_AGG"))


for _f in ("avg", "sum", "median", "min", "max"):
    setattr(Grouped, _f, lambda self, *columns, _f=_f: self._numeric(_f, columns))
Grouped.mean = Grouped.avg


class GroupingSets:
    """Sets of columns to group by, each on its own."""

    def __init__(self, *sets: Any):
        flat = sets[0] if len(sets) == 1 and isinstance(sets[0], (list, tuple)) and sets[0] and isinstance(sets[0][0], (list, tuple, set)) else sets
        self.sets = [[named(c) for c in (s if isinstance(s, (list, tuple, set)) else [s])] for s in flat]
        self.names = [[c for c in (s if isinstance(s, (list, tuple, set)) else [s])] for s in flat]
