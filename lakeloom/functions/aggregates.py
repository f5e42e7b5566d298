"""Aggregate functions whose semantics differ from Spark's namesakes."""

from __future__ import annotations

from decimal import Decimal

from lakeloom.column import Collected, Order
from lakeloom.functions.base import Any, Col, F, named, over_columns

__all__ = [
    "approx_percentile_accumulate", "approx_percentile_combine", "approx_percentile_estimate", "array_agg", "array_union_agg", "boolxor_agg", "count", "grouping", "kurtosis",
    "listagg", "max_by", "min_by", "object_agg", "percentile_cont", "percentile_disc", "skew", "hll", "any_value",
]


def any_value(column: Any) -> Col:
    return Col(F.any_value(named(column)))


def hll(column: Any) -> Col:
    """Approximate number of distinct values."""
    return Col(F.approx_count_distinct(named(column)))


def count(column: Any = "*") -> Col:
    """Rows (``"*"``) or non-null values."""
    return Col(F.count(F.lit(1)) if isinstance(column, str) and column == "*" else F.count(named(column)))


def listagg(column: Any, delimiter: str = "", is_distinct: bool = False) -> Col:
    """Concatenate the non-null values; order by ``within_group``. No value gives the empty string."""
    return Col(None, Collected(named(column), lambda a: F.array_join(F.array_sort(a) if is_distinct else a, delimiter), is_distinct))


def array_agg(column: Any, is_distinct: bool = False) -> Col:
    """The non-null values as an array; order by ``within_group``."""
    return Col(None, Collected(named(column), lambda a: a, is_distinct))


def percentile_cont(fraction: float) -> Col:
    """Interpolated percentile of the column that ``within_group`` orders by."""
    return Col(None, Collected(None, lambda o: F.percentile(o.key, fraction if o.ascending else 1 - fraction)))


def percentile_disc(fraction: float) -> Col:
    """The first value, in order, at which the share of rows reaches the fraction."""

    def finish(o: Order):
        rows = F.sort_array(F.collect_list(o.key), asc=o.ascending)
        return F.element_at(rows, F.greatest(F.lit(1), F.ceil(F.size(rows) * F.lit(fraction)).cast("int")))

    return Col(None, Collected(None, finish))


@over_columns
def approx_percentile_accumulate(column):
    """A mergeable state for percentiles: the group's values in order, so a group must fit a task and nothing is lost."""
    return F.sort_array(F.collect_list(column.cast("double")))


@over_columns
def approx_percentile_combine(state):
    return F.sort_array(F.flatten(F.collect_list(state)))


def approx_percentile_estimate(state: Any, fraction: float) -> Col:
    """The first value at which the share of values reaches the fraction; null without values."""
    rows = named(state)
    # in decimals, as 0.07 * 100 is above 7 in doubles
    place = F.ceil(F.size(rows) * F.lit(Decimal(repr(float(fraction))))).cast("int")
    return Col(F.try_element_at(rows, F.greatest(F.lit(1), place)))


@over_columns
def array_union_agg(column):
    """Multiset union of arrays: each element as often as in the array that holds it most often."""
    distinct = F.array_distinct(F.flatten(F.collect_list(column)))
    times = lambda rows, x: F.array_max(F.transform(rows, lambda a: F.size(F.filter(a, lambda y: y == x))))
    rows = F.collect_list(column)
    return F.flatten(F.transform(distinct, lambda x: F.array_repeat(x, times(rows, x))))


@over_columns
def boolxor_agg(column):
    """True if exactly one value is true; null without values."""
    return F.when(F.count(column) > 0, F.count_if(column.cast("boolean")) == 1)


def grouping(*columns: Any) -> Col:
    """1 where a grouping set leaves the column out; of several columns, their bits."""
    return Col(F.grouping(named(columns[0])) if len(columns) == 1 else F.grouping_id(*[named(c) for c in columns]))


@over_columns
def kurtosis(column):
    """Sample excess kurtosis; null below four values."""
    n = F.count(column).cast("double")
    return F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(column) + 6))


@over_columns
def skew(column):
    """Sample skewness; null below three values."""
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def _by(value: Any, key: Any, n: int | None, largest: bool) -> Col:
    value, key = named(value), named(key)
    if n is None:
        return Col((F.max_by if largest else F.min_by)(value, key))
    rows = F.sort_array(F.collect_list(F.when(key.isNotNull(), F.struct(key.alias("k"), value.alias("v")))), asc=not largest)
    return Col(F.transform(F.slice(rows, 1, n), lambda r: r["v"]))


def max_by(value: Any, key: Any, n: int | None = None) -> Col:
    """The value at the largest key; with ``n``, an array of those at the n largest."""
    return _by(value, key, n, True)


def min_by(value: Any, key: Any, n: int | None = None) -> Col:
    return _by(value, key, n, False)


@over_columns
def object_agg(key, value):
    """A map of key to value, leaving out null keys and values; a repeated key is an error."""
    return F.map_from_entries(F.collect_list(F.when(key.isNotNull() & value.isNotNull(), F.struct(key.alias("key"), value.alias("value")))))
