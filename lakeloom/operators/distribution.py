"""Percent rank and cumulative distribution in groups that do not fit a task.

Both follow from three counts: the rows of the group, those before the row's
place and those up to it. The distinct places are counted, cut into ranges of
their order and summed up within each range; what earlier ranges hold comes
from a table with a row for each range and group. The counts are then joined to
the rows. No task holds a group, and a place that many rows share is one row of
the ranges.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.column import Order


def distribution(frame: DataFrame, keys: list[Column], orders: list[Order], percent_rank: str | None = None, cume_dist: str | None = None) -> DataFrame:
    """Add ``percent_rank`` and ``cume_dist`` (under these names; None leaves one out) of the rows of equal ``keys``, by ``orders``.

    Every row stays. Null keys are a group, and null places are equal and lie
    where their order puts them. The frame is read twice, so its rows must be
    the same each time.
    """
    if not orders:
        raise ValueError("a distribution needs an order")
    n = max(2, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    gs, os = [f"__g{i}" for i in range(len(keys))], [f"__o{i}" for i in range(len(orders))]
    rows = frame.select("*", *[k.alias(g) for k, g in zip(keys, gs)], *[o.key.alias(p) for o, p in zip(orders, os)])
    by_order = [Order(F.col(p), o.ascending, o.nulls_first).column() for o, p in zip(orders, os)]
    counted = rows.groupBy(*gs, *os).agg(F.count(F.lit(1)).alias("__c"))
    # kept, as both uses must see the same ranges
    ranged = counted.repartitionByRange(n, *[F.col(g) for g in gs], *by_order).withColumn("__part", F.spark_partition_id()).persist()
    # of a group, at most one row for each range: what earlier ranges hold of it comes first in its range
    held = ranged.groupBy("__part", *gs).agg(F.sum("__c").alias("__c"))
    earlier = Window.partitionBy(*gs).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    edges = held.select("__part", *gs, F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__c"), F.sum("__c").over(Window.partitionBy(*gs)).alias("__n"))
    both = edges.unionByName(ranged, allowMissingColumns=True)
    within = Window.partitionBy("__part", *gs).orderBy(F.col("__n").isNull(), *by_order).rowsBetween(Window.unboundedPreceding, 0)
    summed = both.select(*gs, *os, "__c", F.sum("__c").over(within).alias("__upto"), F.max("__n").over(within).alias("__total"), F.col("__n").isNull().alias("__place"))
    places = summed.filter("__place").select(*[F.col(c).alias(f"{c}_p") for c in [*gs, *os]], "__upto", "__c", F.col("__total").alias("__n"))
    # places first, as rows are then sorted by a column with many values
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"{c}_p")) for c in [*os, *gs]])
    out = rows.join(places, same)
    before = (F.col("__upto") - F.col("__c")).cast("double")
    if percent_rank:
        out = out.withColumn(percent_rank, F.when(F.col("__n") > 1, before / (F.col("__n") - 1).cast("double")).otherwise(0.0))
    if cume_dist:
        out = out.withColumn(cume_dist, F.col("__upto").cast("double") / F.col("__n").cast("double"))
    return out.drop(*gs, *os, *[f"{c}_p" for c in [*gs, *os]], "__upto", "__c", "__n")

