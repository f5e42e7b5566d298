"""Conditions, nulls and comparison."""

from __future__ import annotations

from lakeloom.column import Case
from lakeloom.functions.base import Any, Col, F, any_null, as_column, named, over_columns, spark

__all__ = ["asc", "asc_nulls_first", "asc_nulls_last", "booland", "boolnot", "boolor", "boolxor", "decode", "desc", "desc_nulls_first", "desc_nulls_last", "div0", "div0null", "divnull", "equal_nan", "equal_null", "greatest", "iff", "in_", "least", "negate", "not_", "nvl", "ifnull", "nullif", "nvl2", "regr_valx", "regr_valy", "when"]


def _sorted(kind: str):
    def order(column: Any) -> Col:
        return getattr(column if isinstance(column, Col) else Col(named(column)), kind)()

    order.__name__ = kind
    return order


asc, asc_nulls_first, asc_nulls_last = (_sorted(k) for k in ("asc", "asc_nulls_first", "asc_nulls_last"))
desc, desc_nulls_first, desc_nulls_last = (_sorted(k) for k in ("desc", "desc_nulls_first", "desc_nulls_last"))


@over_columns
def booland(a, b):
    return a.cast("boolean") & b.cast("boolean")


@over_columns
def boolor(a, b):
    return a.cast("boolean") | b.cast("boolean")


@over_columns
def boolxor(a, b):
    return a.cast("boolean") != b.cast("boolean")


@over_columns
def boolnot(a):
    return ~a.cast("boolean")


def decode(column: Any, *pairs: Any) -> Col:
    """The value after the first search value that equals the column (null equals null); a last odd one is the default."""
    column, pairs = named(column), [as_column(p) for p in pairs]
    out = None
    for key, value in zip(pairs[0::2], pairs[1::2]):
        here = column.eqNullSafe(key)
        out = F.when(here, value) if out is None else out.when(here, value)
    return Col(out.otherwise(pairs[-1]) if len(pairs) % 2 else out)


def div0(a: Any, b: Any) -> Col:
    """a / b, and 0 where b is 0."""
    a, b = named(a), named(b)
    return Col(F.when(b == 0, F.lit(0)).otherwise(a / F.nullif(b, F.lit(0))))


def div0null(a: Any, b: Any) -> Col:
    """a / b, and 0 where b is 0 or null."""
    a, b = named(a), named(b)
    return Col(F.when(F.coalesce(b, F.lit(0)) == 0, F.lit(0)).otherwise(a / F.nullif(b, F.lit(0))))


@over_columns
def divnull(a, b):
    """a / b, and null where b is 0."""
    return a / F.nullif(b, F.lit(0))


@over_columns
def equal_nan(a):
    return F.isnan(a)


@over_columns
def equal_null(a, b):
    return a.eqNullSafe(b)


def greatest(*columns: Any) -> Col:
    """The largest argument; null if any is null."""
    columns = [named(c) for c in columns]
    return Col(F.when(~any_null(columns), F.greatest(*columns) if len(columns) > 1 else columns[0]))


def least(*columns: Any) -> Col:
    """The smallest argument; null if any is null."""
    columns = [named(c) for c in columns]
    return Col(F.when(~any_null(columns), F.least(*columns) if len(columns) > 1 else columns[0]))


def iff(condition: Any, yes: Any, no: Any) -> Col:
    return Col(F.when(as_column(condition), spark(yes)).otherwise(spark(no)))


def in_(columns: list[Any], *values: Any) -> Col:
    """Membership of a tuple of columns in a list of tuples, or in the rows of a frame."""
    rows = values[0] if len(values) == 1 and isinstance(values[0], (list, tuple)) else values
    if not all(isinstance(row, (list, tuple)) for row in rows):
        return Col(F.struct(*[named(c) for c in columns])).in_(*values)
    equal = F.lit(False)
    for row in rows:
        same = F.lit(True)
        for c, v in zip(columns, row, strict=True):
            same = same & (named(c) == as_column(v))
        equal = equal | same
    return Col(equal)


@over_columns
def negate(a):
    return -a


@over_columns
def not_(a):
    return ~a


def nvl(a: Any, b: Any) -> Col:
    return Col(F.nvl(named(a), named(b)))


ifnull = nvl


def nullif(a: Any, b: Any) -> Col:
    return Col(F.nullif(named(a), named(b)))


def nvl2(a: Any, b: Any, c: Any) -> Col:
    return Col(F.nvl2(named(a), named(b), named(c)))


@over_columns
def regr_valx(y, x):
    """x where y is not null."""
    return F.when(y.isNotNull(), x)


@over_columns
def regr_valy(y, x):
    """y where x is not null."""
    return F.when(x.isNotNull(), y)


def when(condition: Any, value: Any) -> Case:
    return Case(F.when(as_column(condition), spark(value)))
