"""Event-time windows over frames, batch or stream, and incremental refresh."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.column import spark


def windowed_counts(events: Any, time_col: str, keys: list[str], size: str, slide: str | None = None, late: str | None = None, **aggregates: Any) -> DataFrame:
    """Aggregates by tumbling (or sliding) window and keys; on a stream, ``late`` bounds the state by a watermark."""
    df = spark(events)
    if late and df.isStreaming:
        df = df.withWatermark(time_col, late)
    window = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    made = [spark(a).alias(n) for n, a in aggregates.items()] or [F.count(F.lit(1)).alias("n")]
    return df.groupBy(window.alias("window"), *keys).agg(*made).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *[c for c in [*aggregates] or ["n"]])


def sessions(events: Any, time_col: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    """Session windows: runs of events closer than ``gap``."""
    df = spark(events)
    if late and df.isStreaming:
        df = df.withWatermark(time_col, late)
    out = df.groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def refresh(stream: Any, table: str, checkpoint: str, mode: str = "append"):
    """Process what has arrived since the last run, into a table, and stop."""
    return spark(stream).writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).toTable(table)
