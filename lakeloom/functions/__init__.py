"""The function library.

Functions whose Spark namesake has the wanted semantics are taken from there on
first use; the modules of this package define the others. All take and return
:class:`lakeloom.column.Col`, and strings in place of columns are column names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.column import Col, named, spark
from lakeloom.functions import aggregates, conditional, context, datetimes, files, geo, models, numeric, semistructured, strings

#: Names of the library whose semantics are those of another Spark function.
ALIASES = {
    "approx_percentile": "percentile_approx", "array_cat": "concat", "array_construct": "array", "array_flatten": "flatten", "array_reverse": "reverse",
    "array_unique_agg": "collect_set", "base64_decode_binary": "unbase64", "bitand_agg": "bit_and", "bitnot": "bitwise_not", "bitor_agg": "bit_or", "bitshiftleft": "shiftleft",
    "bitshiftright": "shiftright", "bitshiftright_unsigned": "shiftrightunsigned", "bitxor_agg": "bit_xor", "booland_agg": "bool_and", "boolor_agg": "bool_or",
    "builtin": "call_function", "call_builtin": "call_function", "column": "col", "corr_samp": "corr", "countDistinct": "count_distinct", "current_database": "current_catalog",
    "current_version": "version", "daydiff": "datediff", "getdate": "current_timestamp", "hash": "xxhash64", "hex_decode_binary": "unhex", "interval_day_time_from_parts": "make_dt_interval",
    "interval_year_month_from_parts": "make_ym_interval", "is_null": "isnull", "is_null_value": "is_variant_null", "localtime": "current_time",
    "map_size": "size", "mean": "avg", "object_keys": "map_keys", "percentile_cont": "percentile", "sign": "signum", "sql_expr": "expr",
    "stddev": "stddev_samp", "systimestamp": "current_timestamp", "timestamp_from_parts": "make_timestamp_ntz", "timestamp_ltz_from_parts": "make_timestamp_ltz",
    "timestamp_ntz_from_parts": "make_timestamp_ntz", "uuid_string": "uuid", "variance": "var_samp", "greatest_ignore_nulls": "greatest", "least_ignore_nulls": "least",
    "array_agg_distinct": "collect_set", "pandas_udtf": "udtf", "vectorized": "pandas_udf",
}

_MODULES = (aggregates, conditional, numeric, strings, datetimes, semistructured, geo, models, context, files)


def wrapped(function: Callable) -> Callable:
    """The function over engine columns: unwraps arguments, wraps columns that it returns."""

    @functools.wraps(function)
    def call(*args: Any, **kwargs: Any) -> Any:
        out = function(*spark(args), **spark(kwargs))
        return Col(out) if isinstance(out, Column) else out

    return call


def col(name: str, *more: str) -> Col:
    """A column by name; with two names, of a frame's alias."""
    return Col(".".join((name, *more)))


def lit(value: Any) -> Col:
    return value if isinstance(value, Col) else Col(F.lit(value))


def __getattr__(name: str) -> Callable:
    if name.startswith("_"):
        raise AttributeError(name)
    for module in _MODULES:
        if name in module.__all__:
            found = getattr(module, name)
            break
    else:
        found = getattr(F, ALIASES.get(name, name), None)
        if found is None:
            raise AttributeError(f"no function {name}")
        found = wrapped(found)
    globals()[name] = found
    return found


def names() -> list[str]:
    """Names that this library defines or renames itself."""
    return sorted({n for m in _MODULES for n in m.__all__} | set(ALIASES) | {"col", "lit"})


def _late(name: str):
    from lakeloom import window

    return getattr(window, name)


def first_value(column: Any, ignore_nulls: bool = False) -> Col:
    """First value of the window; the whole partition unless a frame is given."""
    return _late("first_value")(column, ignore_nulls=ignore_nulls)


def last_value(column: Any, ignore_nulls: bool = False) -> Col:
    return _late("last_value")(column, ignore_nulls=ignore_nulls)


def nth_value(column: Any, n: int, ignore_nulls: bool = False) -> Col:
    return _late("nth_value")(column, n, ignore_nulls=ignore_nulls)


def function(name: str):
    """A function of Spark's by name: ``function("sqrt")("x")``."""
    return lambda *columns: Col(F.call_function(name, *[named(c) for c in columns]))


def table_function(name: str):
    """A table function by name, to be joined or selected from."""
    from lakeloom.udf import TableCall

    return lambda *arguments, **named_arguments: TableCall(name, *arguments, **named_arguments)


def call_table_function(name: str, *arguments: Any, **named_arguments: Any):
    return table_function(name)(*arguments, **named_arguments)


def _registered(kind: str):
    def register(handler: Any, *args: Any, **kwargs: Any):
        from lakeloom.session import Session

        return getattr(Session.get_active_session(), kind).register(handler, *args, **kwargs)

    return register


udaf, sproc = _registered("udaf"), _registered("sproc")


def udf_init_once(function: Callable) -> Callable:
    """Run a function without arguments once for each worker and keep its result."""
    return functools.lru_cache(maxsize=1)(function)


def when_matched(condition: Any = None):
    from lakeloom.operators.dml import WhenMatched

    return WhenMatched(condition)


def when_not_matched(condition: Any = None):
    from lakeloom.operators.dml import WhenNotMatched

    return WhenNotMatched(condition)


def to_decfloat(column: Any, scale: int = 18) -> Col:
    """A decimal of 38 digits; Spark has no decimal floating point."""
    return Col(named(column).cast(f"decimal(38,{scale})"))
