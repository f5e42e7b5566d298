"""Numbers and bits."""

from __future__ import annotations

from lakeloom.functions.base import Any, Col, F, as_column, named, over_columns

__all__ = ["bitand", "bitor", "bitxor", "ceil", "floor", "haversine", "log", "mod", "normal", "random", "seq1", "seq2", "seq4", "seq8", "square", "trunc", "truncate", "uniform", "vector_cosine_distance", "vector_inner_product", "vector_l1_distance", "vector_l2_distance"]

#: Kilometres.
EARTH_RADIUS = 6371.0


@over_columns
def bitand(a, b):
    return a.bitwiseAND(b)


@over_columns
def bitor(a, b):
    return a.bitwiseOR(b)


@over_columns
def bitxor(a, b):
    return a.bitwiseXOR(b)


@over_columns
def ceil(a):
    return F.ceil(a)


@over_columns
def floor(a):
    return F.floor(a)


def haversine(lat1: Any, lon1: Any, lat2: Any, lon2: Any) -> Col:
    """Great-circle distance in kilometres of two points in degrees."""
    a1, o1, a2, o2 = (F.radians(named(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return Col(2 * EARTH_RADIUS * F.asin(F.sqrt(h)))


def log(base: Any, x: Any) -> Col:
    base = F.lit(base) if isinstance(base, (int, float)) else named(base)
    return Col(F.ln(named(x)) / F.ln(base))


@over_columns
def mod(a, b):
    """Remainder with the sign of ``a``."""
    return a % b


def normal(mean: float, deviation: float, generator: Any = None) -> Col:
    """Normally distributed numbers; the generator is a seed."""
    return Col(F.randn(generator if isinstance(generator, int) else None) * deviation + mean)


def random(seed: int | None = None) -> Col:
    """A random signed 64-bit integer for each row."""
    return Col(F.xxhash64(F.rand(seed)))


def uniform(low: Any, high: Any, generator: Any = None) -> Col:
    """Uniform numbers from ``low`` to ``high``; whole numbers if both are. Bounds in columns give fractions only if one is one."""
    share = F.rand(generator if isinstance(generator, int) else None)
    if isinstance(low, Col) or isinstance(high, Col):
        low, high = as_column(low), as_column(high)
        whole = F.typeof(low).isin("tinyint", "smallint", "int", "bigint") & F.typeof(high).isin("tinyint", "smallint", "int", "bigint")
        return Col(F.when(whole, F.floor(share * (high - low + 1)) + low).otherwise(share * (high - low) + low))
    if isinstance(low, int) and isinstance(high, int):
        return Col((F.floor(share * (high - low + 1)) + low).cast("long"))
    return Col(share * (high - low) + low)


def _seq(bits: int):
    def seq(sign: int = 0) -> Col:
        """Increasing numbers from 0, unique within a task's range, wrapping at the width; with ``sign`` 0 they never turn negative."""
        row = F.monotonically_increasing_id()
        if bits == 64:
            return Col(row)
        span = 2 ** (bits - 1) if sign == 0 else 2**bits
        wrapped = row % span
        return Col(F.when(wrapped >= 2 ** (bits - 1), wrapped - 2**bits).otherwise(wrapped))

    return seq


seq1, seq2, seq4, seq8 = _seq(8), _seq(16), _seq(32), _seq(64)


@over_columns
def square(a):
    return a * a


def truncate(column: Any, scale: Any = 0) -> Col:
    """Cut towards zero after ``scale`` digits."""
    column, factor = named(column), F.pow(F.lit(10.0), F.lit(scale) if isinstance(scale, int) else named(scale))
    scaled = column * factor
    return Col(F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)) / factor)


def trunc(column: Any, scale: Any = 0) -> Col:
    """Numbers are cut towards zero; with a unit's name, dates to the start of that unit."""
    return Col(F.trunc(named(column), scale)) if isinstance(scale, str) else truncate(column, scale)


def _sum(a, b, term):
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


@over_columns
def vector_inner_product(a, b):
    return _sum(a, b, lambda x, y: x.cast("double") * y)


@over_columns
def vector_l1_distance(a, b):
    return _sum(a, b, lambda x, y: F.abs(x.cast("double") - y))


@over_columns
def vector_l2_distance(a, b):
    return F.sqrt(_sum(a, b, lambda x, y: F.pow(x.cast("double") - y, F.lit(2))))


@over_columns
def vector_cosine_distance(a, b):
    """Cosine similarity of two vectors."""
    dot = lambda x, y: _sum(x, y, lambda p, q: p.cast("double") * q)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
