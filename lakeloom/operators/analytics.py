"""Moving, cumulative, lagged and time-series aggregates as window expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.datetimes import unit_of

Formatter = Callable[..., str]


def default_name(column: str, operation: str, value: object = None) -> str:
    return "_".join(str(p) for p in (column, operation, value) if p is not None)


def _aggregate(name: str, column: str):
    return getattr(F, {"mean": "avg", "std": "stddev_samp", "stddev": "stddev_samp", "var": "var_samp", "variance": "var_samp"}.get(name.lower(), name.lower()))(F.col(column))


def _keys(aggs: dict, group_by: list[str]) -> None:
    if not isinstance(aggs, dict) or not aggs:
        raise ValueError("aggs must map columns to lists of aggregate names")
    if not group_by:
        raise ValueError("group_by must name at least one column")


def moving_agg(frame: DataFrame, aggs: dict[str, list[str]], window_sizes: list[int], order_by: list[str], group_by: list[str], name: Formatter = default_name) -> DataFrame:
    """Aggregates over the row and those before it, ``window_sizes`` rows in all."""
    _keys(aggs, group_by)
    if any(s < 1 for s in window_sizes):
        raise ValueError("window sizes must be positive")
    base = Window.partitionBy(*group_by).orderBy(*order_by)
    return frame.select("*", *[_aggregate(f, c).over(base.rowsBetween(1 - size, 0)).alias(name(c, f, size)) for c, fs in aggs.items() for size in window_sizes for f in fs])


def cumulative_agg(frame: DataFrame, aggs: dict[str, list[str]], group_by: list[str], order_by: list[str], is_forward: bool, name: Formatter = default_name) -> DataFrame:
    """Aggregates from the row to the partition's end (forward) or from its beginning to the row."""
    _keys(aggs, group_by)
    base = Window.partitionBy(*group_by).orderBy(*order_by)
    window = base.rowsBetween(0, Window.unboundedFollowing) if is_forward else base.rowsBetween(Window.unboundedPreceding, 0)
    return frame.select("*", *[_aggregate(f, c).over(window).alias(name(c, f)) for c, fs in aggs.items() for f in fs])


def shifted(frame: DataFrame, columns: list, steps: list[int], order_by: list[str], group_by: list[str], lead: bool, name: Formatter = default_name) -> DataFrame:
    """Columns of the row so many steps before (lag) or after (lead)."""
    if any(s < 1 for s in steps):
        raise ValueError("steps must be positive")
    window = Window.partitionBy(*group_by).orderBy(*order_by)
    function, kind = (F.lead, "LEAD") if lead else (F.lag, "LAG")
    return frame.select("*", *[function(c, s).over(window).alias(name(str(c), kind, s)) for c in columns for s in steps])


SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def parse_window(window: str) -> tuple[int, str]:
    m = re.fullmatch(r"([+-]?\d+)\s*([a-zA-Z]+)", window.strip())
    if not m:
        raise ValueError(f"not a time window: {window!r}")
    unit = "month" if m[2] in ("MM", "mm", "MON", "mon") else unit_of(m[2])
    if unit not in {*SECONDS, "month", "year"}:
        raise ValueError(f"not a unit of time windows: {m[2]!r}")
    return int(m[1]), unit


def time_series_agg(frame: DataFrame, time_col: str, aggs: dict[str, list[str]], windows: list[str], group_by: list[str], name: Formatter = default_name) -> DataFrame:
    """Aggregates over the rows from the row's time to ``window`` later (``7D``) or earlier (``-7D``).

    Fixed spans are a range frame over microseconds, months and years one over
    month numbers with the day within the month as its fraction.
    """
    _keys(aggs, group_by)
    out = []
    for window in windows:
        amount, unit = parse_window(window)
        if unit in SECONDS:
            key, span = F.unix_micros(F.col(time_col).cast("timestamp")), abs(amount) * SECONDS[unit] * 1_000_000
        else:
            t = F.col(time_col)
            key = ((F.year(t) * 12 + F.month(t)) * 31 * 86400 + (F.dayofmonth(t) - 1) * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("long")
            span = abs(amount) * (12 if unit == "year" else 1) * 31 * 86400
        over = Window.partitionBy(*group_by).orderBy(key)
        over = over.rangeBetween(0, span) if amount >= 0 else over.rangeBetween(-span, 0)
        out += [_aggregate(f, c).over(over).alias(name(c, f, window)) for c, fs in aggs.items() for f in fs]
    return frame.select("*", *out)
