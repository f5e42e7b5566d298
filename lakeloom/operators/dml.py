"""UPDATE, DELETE and MERGE as joins over immutable tables.

Each returns the table's new rows as a frame and the counts of what changed.
Targets are joined once with the source on the bare condition, so its equalities
become keys of sort-merge or broadcast joins by the optimizer's choice; a null
condition is no match. Rows are numbered once, below that join.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.column import as_column


@dataclass
class UpdateResult:
    rows_updated: int
    multi_joined_rows_updated: int = 0


@dataclass
class DeleteResult:
    rows_deleted: int


@dataclass
class MergeResult:
    rows_inserted: int
    rows_updated: int
    rows_deleted: int


@dataclass
class Clause:
    kind: str
    condition: Any = None
    assignments: dict[str, Any] | list[Any] = field(default_factory=dict)


class WhenMatched:
    def __init__(self, condition: Any = None):
        self.condition = condition

    def update(self, assignments: dict[str, Any]) -> Clause:
        return Clause("update", self.condition, assignments)

    def delete(self) -> Clause:
        return Clause("delete", self.condition)


class WhenNotMatched:
    def __init__(self, condition: Any = None):
        self.condition = condition

    def insert(self, assignments: dict[str, Any] | list[Any]) -> Clause:
        return Clause("insert", self.condition, assignments)


def _assigned(target: DataFrame, assignments: dict[str, Any]) -> dict[str, Column]:
    known = {c.lower(): c for c in target.columns}
    unknown = [c for c in assignments if c.lower() not in known]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return {known[c.lower()]: as_column(v) for c, v in assignments.items()}


def _when(condition: Any) -> Column:
    return F.lit(True) if condition is None else F.coalesce(as_column(condition), F.lit(False))


def update(target: DataFrame, assignments: dict[str, Any], condition: Any = None, source: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """The rows after an update, and a column ``__changed`` that is true for changed ones.

    With a source, rows that meet the condition with a source row are updated
    from it; of several source rows an arbitrary one.
    """
    new = _assigned(target, assignments)
    if source is None:
        hit = _when(condition)
        types = dict(target.dtypes)
        columns = [F.when(hit, new[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in target.columns]
        return target.select(*columns, hit.alias("__changed")), F.col("__changed")
    return _joined(target, source, condition, new)


def delete(target: DataFrame, condition: Any = None, source: DataFrame | None = None) -> DataFrame:
    """The rows that stay."""
    if source is None:
        return target.filter(~_when(condition))
    if condition is None:  # any source row will do
        return target.join(source.limit(1), how="left_anti")
    return target.join(source, as_column(condition), "left_anti")


def _joined(target: DataFrame, source: DataFrame, condition: Any, new: dict[str, Column]):
    """One outer join; of the source rows that meet a target row one stays."""
    types = dict(target.dtypes)
    t = target.withColumn("__row", F.monotonically_increasing_id())
    s = source.withColumn("__src", F.lit(1))
    both = t.join(s.limit(1), how="left") if condition is None else t.join(s, as_column(condition), "left")
    hit = F.col("__src").isNotNull()
    columns = [F.when(hit, new[c].cast(types[c])).otherwise(target[c]).alias(c) if c in new else target[c] for c in target.columns]
    return both.select(*columns, hit.alias("__changed"), "__row").dropDuplicates(["__row"]).drop("__row"), F.col("__changed")


def merge(target: DataFrame, source: DataFrame, condition: Any, clauses: list[Clause]) -> DataFrame:
    """The rows after a merge, with ``__action`` (null, ``U``, ``D`` or ``I``; rows marked ``D`` are to be left out).

    Clauses apply in order, the first whose condition holds. A target row that
    several source rows match is an error if one of them would change it.
    """
    types = dict(target.dtypes)
    matched_clauses = [c for c in clauses if c.kind in ("update", "delete")]
    inserts = [c for c in clauses if c.kind == "insert"]
    t = target.withColumn("__row", F.monotonically_increasing_id())
    s = source.withColumn("__src", F.lit(1))
    both = t.join(s, as_column(condition), "full_outer")
    is_match = F.col("__row").isNotNull() & F.col("__src").isNotNull()
    action, taken = F.lit(None).cast("string"), F.lit(-1)
    for i, c in reversed(list(enumerate(matched_clauses))):
        here = is_match & _when(c.condition)
        action = F.when(here, "U" if c.kind == "update" else "D").otherwise(action)
        taken = F.when(here, i).otherwise(taken)
    only_source = F.col("__row").isNull()
    put = F.lit(-1)
    for i, c in reversed(list(enumerate(inserts))):
        here = only_source & _when(c.condition)
        action = F.when(here, "I").otherwise(action)
        put = F.when(here, i).otherwise(put)
    columns = []
    for name in target.columns:
        value = target[name]
        for i, c in enumerate(matched_clauses):
            if c.kind == "update":
                new = _assigned(target, c.assignments)
                if name in new:
                    value = F.when(taken == i, new[name].cast(types[name])).otherwise(value)
        for i, c in enumerate(inserts):
            new = _assigned(target, dict(zip(target.columns, c.assignments)) if isinstance(c.assignments, list) else c.assignments)
            value = F.when(put == i, new[name].cast(types[name]) if name in new else F.lit(None)).otherwise(value)
        columns.append(value.alias(name))
    # rows of the source alone are keys of their own; a target row's copies meet under its number
    key = F.coalesce("__row", -1 - F.monotonically_increasing_id())
    out = both.select(*columns, action.alias("__action"), key.alias("__row")).filter((F.col("__row") >= 0) | (F.col("__action") == "I"))
    copies = Window.partitionBy("__row")
    out = out.withColumn("__n", F.count("__action").over(copies)).withColumn("__nth", F.row_number().over(copies.orderBy(F.col("__action").isNull())))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("several source rows change one target row"))).otherwise(F.col("__action"))
    # of a row that several source rows match, one copy stays: the changed one if there is one
    return out.withColumn("__action", checked.cast("string")).filter("__nth = 1").drop("__n", "__nth", "__row")
