"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import discard, materialize



def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select("v", "u"))
    minima = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "cc-min")
    return both.join(minima, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    minima = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
    rest = down.join(minima, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(minima.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with an edge.

    Each round of two stars lets trees shrink towards their smallest node; the
    rounds grow with the logarithm of the number of nodes. Edges stay in
    tables, one for each round; only their count and a checksum reach the
    driver.
    """
    now = materialize(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc-edges")
    mark = None
    while True:
        after = materialize(_small_star(materialize(_large_star(now), "cc-large")), "cc-edges")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        discard(now)
        now = after
        if state == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = state
