"""Sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample(frame: DataFrame, frac: float | None = None, n: int | None = None, seed: int | None = None) -> DataFrame:
    """Each row with probability ``frac``, or ``n`` rows (fewer if there are fewer)."""
    if (frac is None) == (n is None):
        raise ValueError("give either frac or n")
    if frac is not None:
        if not 0 <= frac <= 1:
            raise ValueError("frac must be between 0 and 1")
        return frame.sample(False, frac, seed)
    if n < 0:
        raise ValueError("n must not be negative")
    # a top-n over random keys: each task keeps n rows, and no full sort takes place
    return frame.withColumn("__r", F.rand(seed)).orderBy("__r").limit(n).drop("__r")


def sample_by(frame: DataFrame, column: Column, fractions: dict, seed: int | None = None) -> DataFrame:
    """For each key of ``fractions`` that share of its rows, rounded; other keys are left out."""
    wanted = F.lit(0.0)
    for key, share in fractions.items():
        wanted = F.when(column.eqNullSafe(F.lit(key)), F.lit(float(share))).otherwise(wanted)
    rank = F.percent_rank().over(Window.partitionBy(column).orderBy(F.rand(seed)))
    return frame.filter(wanted > 0).withColumn("__p", rank).filter(F.col("__p") <= wanted).drop("__p")
