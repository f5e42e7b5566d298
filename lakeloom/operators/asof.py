"""As-of join: for each left row, the nearest right row at or before (or after) it.

One window over the union of both sides, partitioned by the equality keys and
ordered by the match column: a row takes the last right row before it. It costs
one shuffle by key and one sort, and no pair of rows is built. Without keys the
time line is cut into ranges; each range takes the last row of those before it
from a small table with one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATORS = {">=", ">", "<=", "<"}


def asof_join(left: DataFrame, right: DataFrame, left_match: str, op: str, right_match: str, on: list[tuple[str, str]] | None = None, suffixes: tuple[str, str] = ("", "_r")) -> DataFrame:
    """Left outer as-of join on ``left.left_match op right.right_match`` and equality of the ``on`` pairs.

    Of several right rows at the nearest place, an arbitrary but fixed one (the
    largest row) is taken. Rows with a null match value or key stay unmatched.
    Right columns whose names the left has get the second suffix.
    """
    if op not in OPERATORS:
        raise ValueError(f"an as-of condition is one of {sorted(OPERATORS)}, not {op!r}")
    on = on or []
    back, strict = op in (">=", ">"), op in (">", "<")
    taken = {c.lower() for c in left.columns}
    names = {c: c + suffixes[1] if c.lower() in taken else c for c in right.columns}
    rvalue = F.struct(*[F.col(c).alias(names[c]) for c in right.columns])
    keys = [f"k{i}" for i in range(len(on))]
    lrows = left.select(*[F.col(a).alias(k) for (a, _), k in zip(on, keys)], F.col(left_match).alias("at"), F.struct(*left.columns).alias("l"), F.lit(None).alias("r"))
    rrows = right.filter(F.col(right_match).isNotNull()).select(*[F.col(b).alias(k) for (_, b), k in zip(on, keys)], F.col(right_match).alias("at"), F.lit(None).alias("l"), rvalue.alias("r"))
    both = lrows.unionByName(rrows)
    # at one place: right rows first if they count, last if the condition is strict
    side = F.when(F.col("l").isNull(), 0 if not strict else 1).otherwise(1 if not strict else 0)
    order = [F.col("at").asc() if back else F.col("at").desc(), side.asc(), F.col("r").asc() if _orderable(right) else F.lit(0)]
    last = F.last("r", ignorenulls=True)
    if keys:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        matched = both.withColumn("hit", last.over(window))
    else:
        matched = _without_keys(both, order, last)
    found = F.when(F.col("at").isNotNull() & _all_known(keys), F.col("hit"))
    return matched.filter(F.col("l").isNotNull()).select("l.*", found.alias("hit")).select(*left.columns, *[F.col(f"hit.`{n}`").alias(n) for n in names.values()])


def _all_known(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def _orderable(frame: DataFrame) -> bool:
    return not any(t.startswith(("map", "variant")) for _, t in frame.dtypes)


def _without_keys(both: DataFrame, order: list[Column], last: Column) -> DataFrame:
    spark = both.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged = both.repartitionByRange(n, order[0]).withColumn("part", F.spark_partition_id()).persist()
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # one row for each range, so this window is small whatever the input
    edges = ranged.filter(F.col("r").isNotNull()).groupBy("part").agg(F.max_by("r", F.struct("at", "r")).alias("edge") if "ASC" in str(order[0]) else F.min_by("r", F.struct("at", "r")).alias("edge"))
    parts = spark.range(n).select(F.col("id").cast("int").alias("part")).join(edges, "part", "left")
    carried = parts.select("part", F.last("edge", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    return ranged.join(F.broadcast(carried), "part").withColumn("hit", F.coalesce(last.over(inside), "before")).drop("before", "part")
