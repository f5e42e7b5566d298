"""Column expressions with the engine's operators on top of Spark's."""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spark(value: Any) -> Any:
    """Spark's own object behind an engine object; containers are searched, everything else is returned as it is."""
    if isinstance(value, Col):
        return value.c
    if isinstance(value, (list, tuple)):
        return type(value)(spark(v) for v in value)
    if isinstance(value, dict):
        return {k: spark(v) for k, v in value.items()}
    return value._spark_object if hasattr(type(value), "_spark_object") else value


def as_column(value: Any) -> Column:
    """A Spark column: of a :class:`Col`, a column, or a literal."""
    value = spark(value)
    return value if isinstance(value, Column) else F.lit(value)


def named(value: Any) -> Column:
    """A Spark column: strings are column names."""
    value = spark(value)
    return F.col(unquoted(value)) if isinstance(value, str) else as_column(value)


def unquoted(name: str) -> str:
    """A column name in Spark's spelling: ``"x"`` in double quotes names x exactly."""
    if len(name) > 1 and name[0] == name[-1] == '"':
        return "`" + name[1:-1].replace('""', '"').replace("`", "``") + "`"
    return name


@dataclass(frozen=True)
class Order:
    """A sort key: by default nulls come first ascending and last descending."""

    key: Column
    ascending: bool = True
    nulls_first: bool | None = None

    @property
    def nulls_lead(self) -> bool:
        return self.ascending if self.nulls_first is None else self.nulls_first

    def column(self) -> Column:
        kind = ("asc" if self.ascending else "desc") + ("_nulls_first" if self.nulls_lead else "_nulls_last")
        return getattr(self.key, kind)()


@dataclass
class Collected:
    """An aggregate whose input order can be set afterwards by ``within_group``."""

    values: Column
    finish: Any
    distinct: bool = False
    orders: list[Order] = field(default_factory=list)

    def column(self) -> Column:
        if not self.orders:
            return self.finish(F.collect_set(self.values) if self.distinct else F.collect_list(self.values))
        fields = [o.key.alias(f"k{i}") for i, o in enumerate(self.orders)]
        rows = F.collect_set if self.distinct else F.collect_list
        kept = F.when(self.values.isNotNull(), F.struct(*fields, self.values.alias("v")))

        def compare(a, b):
            out = F.lit(0)
            for i, o in reversed(list(enumerate(self.orders))):
                x, y = a[f"k{i}"], b[f"k{i}"]
                null = -1 if o.nulls_lead else 1
                less = -1 if o.ascending else 1
                here = F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), null).when(y.isNull(), -null).when(x < y, less).when(x > y, -less).otherwise(0)
                out = F.when(here != 0, here).otherwise(out)
            return out

        return self.finish(F.transform(F.array_sort(rows(kept), compare), lambda r: r["v"]))


class Col:
    """A column expression. Methods that it lacks come from Spark's column."""

    __slots__ = ("_c", "collected", "order", "label")
    __hash__ = object.__hash__

    def __init__(self, c: Any, collected: Collected | None = None, order: Order | None = None, label: str | None = None):
        c = spark(c)
        self.label = label or (c if isinstance(c, str) else None)
        self._c = (F.col(unquoted(c)) if isinstance(c, str) else c) if c is not None else None
        self.collected, self.order = collected, order

    @property
    def c(self) -> Column:
        if self.order is not None:
            return self.order.column()
        return self.collected.column() if self._c is None else self._c

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        found = getattr(self.c, name)
        if not callable(found):
            return found

        def call(*args, **kwargs):
            out = found(*spark(args), **spark(kwargs))
            return Col(out) if isinstance(out, Column) else out

        return call

    def __repr__(self) -> str:
        return f"Col<{self.c}>"

    def __bool__(self):
        raise TypeError("a column has no truth value; combine conditions with & | ~")

    # access
    def __getitem__(self, item: Any) -> Col:
        """An array's element by place from 0, an object's or struct's by key; null where there is none."""
        return Col(F.get(self.c, item) if isinstance(item, int) else self.c[spark(item)])

    getItem = getField = __getitem__

    # predicates
    def in_(self, *values: Any) -> Col:
        """Membership in values, lists of values, or the only column of a frame."""
        if len(values) == 1 and isinstance(spark(values[0]), DataFrame):
            return Col(_in_frame(self.c, spark(values[0])))
        flat = [v for x in values for v in (x if isinstance(x, (list, set)) else [x])]
        if any(isinstance(v, tuple) for v in flat):
            return Col(self.c.isin(*[F.struct(*[as_column(x) for x in v]) for v in flat]))
        return Col(self.c.isin(*spark(flat)))

    isin = in_

    def between(self, low: Any, high: Any) -> Col:
        return Col(self.c.between(spark(low), spark(high)))

    def equal_null(self, other: Any) -> Col:
        return Col(self.c.eqNullSafe(spark(other)))

    eqNullSafe = equal_null

    def equal_nan(self) -> Col:
        return Col(F.isnan(self.c))

    def is_null(self) -> Col:
        return Col(self.c.isNull())

    def is_not_null(self) -> Col:
        return Col(self.c.isNotNull())

    isNull, isNotNull = is_null, is_not_null

    def like(self, pattern: Any) -> Col:
        return Col(F.like(self.c, as_column(pattern)))

    def regexp(self, pattern: Any, parameters: str = "") -> Col:
        """True if the whole string matches; ``parameters`` as in :func:`lakeloom.functions.strings.flags`."""
        from lakeloom.functions.strings import whole

        return Col(F.regexp_like(self.c, whole(pattern, parameters)))

    rlike = regexp

    # bits
    def bitand(self, other: Any) -> Col:
        return Col(self.c.bitwiseAND(as_column(other)))

    def bitor(self, other: Any) -> Col:
        return Col(self.c.bitwiseOR(as_column(other)))

    def bitxor(self, other: Any) -> Col:
        return Col(self.c.bitwiseXOR(as_column(other)))

    bitwiseAnd, bitwiseAND, bitwiseOR, bitwiseXOR = bitand, bitand, bitor, bitxor

    # strings and types
    def substr(self, start: Any, length: Any) -> Col:
        return Col(F.substring(self.c, spark(start), spark(length)) if isinstance(start, int) and isinstance(length, int) else self.c.substr(as_column(start), as_column(length)))

    substring = substr

    def collate(self, name: str) -> Col:
        return Col(F.collate(self.c, name))

    def cast(self, to: Any, rename_fields: bool = False, add_fields: bool = False) -> Col:
        return Col(self.c.cast(to))

    astype = cast

    def try_cast(self, to: Any, rename_fields: bool = False, add_fields: bool = False, permissive: bool = False) -> Col:
        return Col(self.c.try_cast(to))

    # names
    def as_(self, name: str) -> Col:
        return Col(self.c.alias(unquoted(name).strip("`")), label=name)

    alias = name = as_

    def get_name(self) -> str | None:
        return self.label

    getName = get_name

    # order
    def asc(self) -> Col:
        return Col(self._c, self.collected, Order(self.c, True))

    def asc_nulls_first(self) -> Col:
        return Col(self._c, self.collected, Order(self.c, True, True))

    def asc_nulls_last(self) -> Col:
        return Col(self._c, self.collected, Order(self.c, True, False))

    def desc(self) -> Col:
        return Col(self._c, self.collected, Order(self.c, False))

    def desc_nulls_first(self) -> Col:
        return Col(self._c, self.collected, Order(self.c, False, True))

    def desc_nulls_last(self) -> Col:
        return Col(self._c, self.collected, Order(self.c, False, False))

    def over(self, window: Any = None) -> Col:
        """A window expression; without a window, over all rows."""
        from pyspark.sql import Window

        whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return Col(self.c.over(whole if window is None else spark(window)))

    def within_group(self, *keys: Any) -> Col:
        """Set the input order of an aggregate that collects its rows (or the column of a percentile)."""
        keys = [k for x in keys for k in (x if isinstance(x, (list, tuple)) else [x])]
        if self.collected is None:
            raise ValueError("within_group needs an ordered aggregate such as listagg or array_agg")
        orders = [as_order(k) for k in keys]
        if self.collected.values is None:
            return Col(self.collected.finish(orders[0]))
        return Col(None, Collected(self.collected.values, self.collected.finish, self.collected.distinct, orders))


def as_order(key: Any) -> Order:
    if isinstance(key, Col) and key.order is not None:
        return key.order
    return Order(named(key))


def _in_frame(column: Column, frame: DataFrame) -> Column:
    """``column IN (subquery)``: existence of a row with the value."""
    inner = frame.select(F.col(frame.columns[0]).alias("in_value"))
    return inner.filter(F.col("in_value") == column.outer()).exists()


def _binary(op):
    def method(self, other):
        return Col(op(self.c, spark(other)))

    return method


def _reflected(op):
    def method(self, other):
        return Col(op(as_column(other), self.c))

    return method


for _name in "eq ne gt lt ge le add sub mul truediv mod and or".split():
    setattr(Col, f"__{_name}__", _binary(getattr(operator, f"__{_name}__")))
for _name in "add sub mul truediv mod and or".split():
    setattr(Col, f"__r{_name}__", _reflected(getattr(operator, f"__{_name}__")))
Col.__pow__ = lambda self, other: Col(F.pow(self.c, as_column(other)))
Col.__rpow__ = lambda self, other: Col(F.pow(as_column(other), self.c))
Col.__neg__ = lambda self: Col(-self.c)
Col.__invert__ = lambda self: Col(~self.c)


class Case(Col):
    """``CASE WHEN``: more conditions by ``when``, a default by ``otherwise``."""

    def when(self, condition: Any, value: Any) -> Case:
        return Case(self.c.when(as_column(condition), spark(value)))

    def otherwise(self, value: Any) -> Col:
        return Col(self.c.otherwise(spark(value)))

    else_ = otherwise
