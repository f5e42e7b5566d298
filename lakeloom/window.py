"""Window specifications."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from lakeloom.column import Col, as_order, named, spark


class Spec:
    """Partitions, order and frame of a window."""

    def __init__(self, partitions=(), orders=(), frame=None):
        self.partitions, self.orders, self.frame = tuple(partitions), tuple(orders), frame

    @staticmethod
    def _flat(columns: tuple) -> list[Any]:
        return [c for x in columns for c in (x if isinstance(x, (list, tuple)) else [x])]

    def partition_by(self, *columns: Any) -> Spec:
        return Spec([named(c) for c in self._flat(columns)], self.orders, self.frame)

    def order_by(self, *columns: Any) -> Spec:
        return Spec(self.partitions, [as_order(c) for c in self._flat(columns)], self.frame)

    def rows_between(self, start: Any, end: Any) -> Spec:
        return Spec(self.partitions, self.orders, ("rows", start, end))

    def range_between(self, start: Any, end: Any) -> Spec:
        """Bounds are numbers, or intervals over a single time column (as columns or day-time text such as ``1 day``)."""
        return Spec(self.partitions, self.orders, ("range", start, end))

    partitionBy, orderBy, rowsBetween, rangeBetween = partition_by, order_by, rows_between, range_between

    @property
    def _spark_object(self):
        spec = SparkWindow.partitionBy(*self.partitions)
        if self.orders:
            spec = spec.orderBy(*[o.column() for o in self.orders])
        if self.frame:
            kind, start, end = self.frame
            if isinstance(start, Interval) or isinstance(end, Interval):
                if len(self.orders) != 1:
                    raise ValueError("an interval frame needs exactly one order column")
                spec = SparkWindow.partitionBy(*self.partitions)
                key = F.unix_micros(self.orders[0].key.cast("timestamp"))
                spec = spec.orderBy(key.asc() if self.orders[0].ascending else key.desc())
                start, end = (b.micros if isinstance(b, Interval) else b for b in (start, end))
            spec = spec.rowsBetween(spark(start), spark(end)) if kind == "rows" else spec.rangeBetween(spark(start), spark(end))
        return spec


class Interval:
    """A fixed span of time as a frame bound; negative spans lie before the row."""

    SCALE = {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}

    def __init__(self, amount: float, unit: str):
        from lakeloom.functions.datetimes import unit_of

        self.micros = int(amount * self.SCALE[unit_of(unit)])

    def __neg__(self) -> Interval:
        out = Interval(0, "second")
        out.micros = -self.micros
        return out


class Window:
    """Constructors of window specifications, and the frame bounds."""

    UNBOUNDED_PRECEDING = unboundedPreceding = SparkWindow.unboundedPreceding
    UNBOUNDED_FOLLOWING = unboundedFollowing = SparkWindow.unboundedFollowing
    CURRENT_ROW = currentRow = SparkWindow.currentRow

    @staticmethod
    def partition_by(*columns: Any) -> Spec:
        return Spec().partition_by(*columns)

    @staticmethod
    def order_by(*columns: Any) -> Spec:
        return Spec().order_by(*columns)

    @staticmethod
    def rows_between(start: Any, end: Any) -> Spec:
        return Spec().rows_between(start, end)

    @staticmethod
    def range_between(start: Any, end: Any) -> Spec:
        return Spec().range_between(start, end)

    partitionBy, orderBy, rowsBetween, rangeBetween = partition_by, order_by, rows_between, range_between


def full(spec: Spec) -> Spec:
    """The spec with the whole partition as its frame unless it has one: the default of first, last and nth value."""
    return spec if spec.frame else spec.rows_between(Window.UNBOUNDED_PRECEDING, Window.UNBOUNDED_FOLLOWING)


def value_function(name: str):
    """first_value, last_value or nth_value with the whole partition as default frame."""

    class Value(Col):
        __slots__ = ()

        def over(self, window: Any = None) -> Col:
            return Col.over(self, full(window) if isinstance(window, Spec) else window)

    def call(column: Any, *args: Any, ignore_nulls: bool = False) -> Col:
        function = {"first_value": F.first_value, "last_value": F.last_value, "nth_value": F.nth_value}[name]
        return Value(function(named(column), *args, ignore_nulls))

    call.__name__ = name
    return call


first_value, last_value, nth_value = (value_function(n) for n in ("first_value", "last_value", "nth_value"))
