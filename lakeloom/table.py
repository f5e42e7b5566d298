"""Named tables that can be changed."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakeloom.column import spark
from lakeloom.frame import Frame
from lakeloom.operators import dml


class Table(Frame):
    """A table. Changes write the new rows once, beside the old ones, then swap the names; they return counts."""

    def __init__(self, session: SparkSession, name: str, df: DataFrame | None = None):
        super().__init__(session.table(name) if df is None else df)
        self.table_name = name

    def _replace(self, rows: DataFrame, **counts: Any) -> dict[str, int]:
        """Write ``rows`` to a table made like this one and give it this one's name; ``counts`` are aggregates taken while writing.

        The old rows lie under another name until the new ones have theirs, so
        no failure in between loses them.
        """
        session, name, tag = self.session, self.table_name, uuid.uuid4().hex[:12]
        new, old = f"{name}_new_{tag}", f"{name}_old_{tag}"
        kept = rows.filter("__keep").select(*self._df.columns)
        seen = Observation() if counts else None
        if seen:
            kept = rows.observe(seen, *[c.alias(n) for n, c in counts.items()]).filter("__keep").select(*self._df.columns)
        told = {r.key: r.value for r in session.sql(f"SHOW TBLPROPERTIES {name}").collect() if hasattr(r, "value") and r.key not in ("transient_lastDdlTime", "numFiles", "totalSize")}
        quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        properties = f" TBLPROPERTIES ({', '.join(f'{quoted(k)} = {quoted(v)}' for k, v in told.items())})" if told else ""
        session.sql(f"CREATE TABLE {new} LIKE {name}{properties}")
        kept.write.insertInto(new)
        session.sql(f"ALTER TABLE {name} RENAME TO {old}")
        session.sql(f"ALTER TABLE {new} RENAME TO {name}")
        session.sql(f"DROP TABLE {old}")
        self._df = session.table(name)
        return seen.get if seen else {}

    def update(self, assignments: dict[str, Any], condition: Any = None, source: Any = None, **_: Any) -> dml.UpdateResult:
        rows, changed = dml.update(self._df, assignments, condition, spark(source))
        return dml.UpdateResult(self._replace(rows.withColumn("__keep", F.lit(True)), n=F.count(F.when(changed, 1)))["n"])

    def delete(self, condition: Any = None, source: Any = None, **_: Any) -> dml.DeleteResult:
        before = self._df.count()
        rows = dml.delete(self._df, condition, spark(source)).withColumn("__keep", F.lit(True))
        return dml.DeleteResult(before - self._replace(rows, n=F.count(F.lit(1)))["n"])

    def merge(self, source: Any, join_expr: Any, clauses: list[dml.Clause], **_: Any) -> dml.MergeResult:
        rows = dml.merge(self._df, spark(source), join_expr, clauses).withColumn("__keep", ~F.col("__action").eqNullSafe("D"))
        n = self._replace(rows, **{kind: F.count(F.when(F.col("__action") == kind, 1)) for kind in "IUD"})
        return dml.MergeResult(n["I"], n["U"], n["D"])

    def sample(self, frac: float | None = None, n: int | None = None, seed: int | None = None, sampling_method: str | None = None) -> Frame:
        return super().sample(frac, n, seed)

    def drop_table(self) -> None:
        self.session.sql(f"DROP TABLE IF EXISTS {self.table_name}")


when_matched, when_not_matched = dml.WhenMatched, dml.WhenNotMatched
