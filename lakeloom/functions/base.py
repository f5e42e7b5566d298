"""What the function modules share."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.column import Col, as_column, named, spark

__all__ = ["Any", "Callable", "Col", "Column", "F", "any_null", "as_column", "named", "over_columns", "spark"]


def any_null(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c.isNull()
    return out


def over_columns(function: Callable[..., Column]) -> Callable[..., Col]:
    """Decorator: positional arguments become Spark columns (strings are names), the result an engine column."""
    import functools

    @functools.wraps(function)
    def call(*args: Any, **kwargs: Any) -> Col:
        return Col(function(*(named(a) for a in args), **spark(kwargs)))

    return call
