"""Dates, times and intervals."""

from __future__ import annotations

from lakeloom.functions.base import Any, Col, F, as_column, named, over_columns, spark

__all__ = [
    "add_months", "convert_timezone", "current_time", "date_add", "date_format", "date_from_parts", "date_part", "date_sub", "date_trunc", "dateadd", "datediff", "dayname", "dayofweek", "last_day", "make_interval", "monthname", "next_day",
    "previous_day", "sysdate", "time_from_parts", "time_slice", "timestamp_tz_from_parts", "to_date", "to_time", "to_timestamp", "to_timestamp_ntz", "to_timestamp_ltz", "to_timestamp_tz",
]

#: Tokens of date formats and their Java patterns, longest first (fixed values).
TOKENS = [("HH24", "HH"), ("HH12", "hh"), ("YYYY", "yyyy"), ("MMMM", "MMMM"), ("FF9", "SSSSSSSSS"), ("FF6", "SSSSSS"), ("FF3", "SSS"), ("TZH:TZM", "XXX"), ("MON", "MMM"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("DY", "EEE"), ("MI", "mm"), ("SS", "ss"), ("AM", "a"), ("PM", "a")]
#: Names of units and their singular form (fixed values).
UNITS = {
    "y": "year", "yy": "year", "yyy": "year", "yyyy": "year", "yr": "year", "years": "year", "yrs": "year", "q": "quarter", "qtr": "quarter", "qtrs": "quarter", "quarters": "quarter", "mm": "month", "mon": "month", "mons": "month",
    "months": "month", "w": "week", "wk": "week", "weekofyear": "week", "woy": "week", "wy": "week", "weeks": "week", "d": "day", "dd": "day", "days": "day", "dayofmonth": "day", "h": "hour", "hh": "hour", "hr": "hour", "hours": "hour", "hrs": "hour",
    "m": "minute", "mi": "minute", "min": "minute", "minutes": "minute", "mins": "minute", "s": "second", "sec": "second", "seconds": "second", "secs": "second", "ms": "millisecond", "msec": "millisecond", "milliseconds": "millisecond",
    "us": "microsecond", "usec": "microsecond", "microseconds": "microsecond",
}


def unit_of(name: str) -> str:
    return UNITS.get(name.lower(), name.lower())


def java_format(pattern: str) -> str:
    """A format such as ``YYYY-MM-DD HH24:MI:SS`` in Java's letters; quoted parts stay as they are."""
    out, at = "", 0
    while at < len(pattern):
        for token, java in TOKENS:
            if pattern[at : at + len(token)].upper() == token:
                out, at = out + java, at + len(token)
                break
        else:
            c = pattern[at]
            if c == '"':
                end = pattern.index('"', at + 1)
                out, at = out + "'" + pattern[at + 1 : end] + "'", end + 1
            else:
                out, at = out + ("'T'" if c == "T" else c), at + 1
    return out


def add_months(c: Any, n: Any) -> Col:
    """Add months; the last day of a month stays one."""
    c, n = named(c), as_column(n)
    moved = F.add_months(c, n)
    return Col(F.when(F.to_date(c) == F.last_day(c), F.last_day(moved)).otherwise(moved))


def convert_timezone(*arguments: Any) -> Col:
    """(source, target, timestamp without zone) or (target, timestamp)."""
    if len(arguments) == 2:
        return Col(F.convert_timezone(None, _word(arguments[0]), named(arguments[1])))
    source, target, c = arguments
    return Col(F.convert_timezone(_word(source), _word(target), named(c)))


def _word(value: Any):
    value = spark(value)
    return F.lit(value) if isinstance(value, str) else value


def current_time() -> Col:
    return Col(F.date_format(F.current_timestamp(), "HH:mm:ss"))


def date_add(c: Any, n: Any) -> Col:
    return Col(F.date_add(named(c), as_column(n)))


def date_sub(c: Any, n: Any) -> Col:
    return Col(F.date_sub(named(c), as_column(n)))


def date_format(c: Any, pattern: str) -> Col:
    return Col(F.date_format(named(c), java_format(pattern)))


def date_from_parts(y: Any, m: Any, d: Any) -> Col:
    """A date of parts that may lie outside their range: month 13 is January of the next year, day 0 the day before the first."""
    y, m, d = (named(x) if isinstance(x, str) else as_column(x) for x in (y, m, d))
    return Col(F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1), d - 1))


def date_part(part: str, c: Any) -> Col:
    part, c = part.lower(), named(c)
    if part in ("dayofweek", "weekday", "dow", "dw"):
        return Col(F.dayofweek(c) - 1)
    if part.startswith("epoch"):
        micros = F.unix_micros(c.cast("timestamp"))
        scale = {"epoch_second": 1_000_000, "epoch": 1_000_000, "epoch_millisecond": 1000, "epoch_microsecond": 1}[part]
        return Col(F.floor(micros / scale).cast("long"))
    names = {"dayofweekiso": "dow_iso", "dayofweek_iso": "dow_iso", "yearofweek": "yearofweek", "dayofyear": "doy", "yearday": "doy", "doy": "doy"}
    part = names.get(part, unit_of(part))
    return Col((F.weekday(c) + 1) if part == "dow_iso" else F.date_part(F.lit(part), c))


def date_trunc(unit: str, c: Any) -> Col:
    return Col(F.date_trunc(unit_of(unit), named(c)))


def dateadd(unit: str, n: Any, c: Any) -> Col:
    return Col(F.timestamp_add(unit_of(unit).upper(), as_column(n), named(c)))


def datediff(unit: str, start: Any, end: Any) -> Col:
    """Boundaries of the unit that lie between the two: the difference of the truncated times."""
    unit, start, end = unit_of(unit), named(start), named(end)
    if unit in ("year", "quarter", "month"):
        months = {"year": 12, "quarter": 3, "month": 1}[unit]
        place = lambda c: F.floor((F.year(c) * 12 + F.month(c) - 1) / months)
        return Col((place(end) - place(start)).cast("long"))
    if unit == "day":
        return Col(F.datediff(end, start).cast("long"))
    if unit == "week":
        return Col(F.floor(F.datediff(F.date_trunc("week", end), F.date_trunc("week", start)) / 7).cast("long"))
    micros = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}[unit]
    place = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / micros)
    return Col((place(end) - place(start)).cast("long"))


@over_columns
def dayname(c):
    return F.date_format(c, "EEE")


@over_columns
def monthname(c):
    return F.date_format(c, "MMM")


@over_columns
def dayofweek(c):
    """0 (Sunday) to 6."""
    return F.dayofweek(c) - 1


def last_day(c: Any, part: str = "month") -> Col:
    part, c = unit_of(part), named(c)
    if part == "month":
        return Col(F.last_day(c))
    start = F.date_trunc(part, c)
    months = {"year": 12, "quarter": 3}.get(part)
    return Col(F.date_sub(F.add_months(start, F.lit(months)), 1) if months else F.date_add(F.to_date(start), 6))


def make_interval(years: int = 0, quarters: int = 0, months: int = 0, weeks: int = 0, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0, milliseconds: int = 0, microseconds: int = 0, **_: Any) -> Col:
    parts = (years, months + 3 * quarters, weeks, days, hours, minutes)
    return Col(F.make_interval(*[F.lit(p) for p in parts], F.lit(seconds + milliseconds / 1e3 + microseconds / 1e6)))


def next_day(c: Any, day: Any) -> Col:
    return Col(F.next_day(named(c), spark(day)))


def previous_day(c: Any, day: Any) -> Col:
    """The last such weekday before the date."""
    return Col(F.next_day(F.date_sub(named(c), 8), spark(day)))


def sysdate() -> Col:
    return Col(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))


def time_slice(c: Any, length: int, unit: str, side: str = "START") -> Col:
    """Start or end of the slice of ``length`` units, counted from 1970, that holds the time."""
    c, unit = named(c), unit_of(unit)
    if unit in ("year", "quarter", "month"):
        months = {"year": 12, "quarter": 3, "month": 1}[unit] * length
        start = F.add_months(F.lit("1970-01-01").cast("date"), (F.floor(((F.year(c) - 1970) * 12 + F.month(c) - 1) / months) * months).cast("int"))
        return Col(start if side.upper() == "START" else F.add_months(start, F.lit(months)))
    micros = {"week": 604_800_000_000, "day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}[unit] * length
    shift = 3 * 86_400_000_000 if unit == "week" else 0  # weeks begin on Monday, and 1970 on a Thursday
    start = F.floor((F.unix_micros(c.cast("timestamp")) + shift) / micros) * micros - shift
    return Col(F.timestamp_micros((start if side.upper() == "START" else start + micros).cast("long")))


def timestamp_tz_from_parts(y: Any, m: Any, d: Any, h: Any, mi: Any, s: Any, nanos: Any = 0, zone: Any = None) -> Col:
    parts = [named(x) if isinstance(x, str) else as_column(x) for x in (y, m, d, h, mi)]
    seconds = (named(s) if isinstance(s, str) else as_column(s)) + as_column(nanos) / 1e9
    seconds = seconds.cast("decimal(16,6)")
    return Col(F.make_timestamp(*parts, seconds) if zone is None else F.make_timestamp(*parts, seconds, _word(zone)))


def to_date(c: Any, pattern: str | None = None) -> Col:
    return Col(F.to_date(named(c)) if pattern is None or pattern.upper() == "AUTO" else F.to_date(named(c), java_format(pattern)))


def time_from_parts(h: Any, mi: Any, s: Any, nanos: Any = 0) -> Col:
    """The time of day as text ``HH:mm:ss``, like :func:`to_time`; fractions of a second are cut."""
    h, mi, s = (as_column(x) for x in (h, mi, s))
    return Col(F.date_format(F.timestamp_seconds(((h * 60 + mi) * 60 + s) % 86400), "HH:mm:ss"))


def to_time(c: Any, pattern: str = "HH24:MI:SS") -> Col:
    """The time of day as text ``HH:mm:ss``."""
    return Col(F.date_format(F.to_timestamp(named(c).cast("string"), java_format(pattern)), "HH:mm:ss"))


def _timestamp(function):
    def convert(c: Any, pattern: str | None = None) -> Col:
        return Col(function(named(c)) if pattern is None or pattern.upper() == "AUTO" else function(named(c), F.lit(java_format(pattern))))

    return convert


def to_timestamp(c: Any, pattern: str | None = None) -> Col:
    return Col(F.to_timestamp(named(c)) if pattern is None or pattern.upper() == "AUTO" else F.to_timestamp(named(c), java_format(pattern)))


to_timestamp_ntz, to_timestamp_ltz = _timestamp(F.to_timestamp_ntz), _timestamp(F.to_timestamp_ltz)


def to_timestamp_tz(c: Any, pattern: str | None = None) -> Col:
    """A struct of the instant and, where the text gives one, its offset in minutes."""
    c = named(c)
    sign = F.when(F.regexp_extract(c.cast("string"), r"([+-])\d\d:?\d\d$", 1) == "-", -1).otherwise(1)
    offset = F.nullif(F.regexp_extract(c.cast("string"), r"[+-](\d\d):?\d\d$", 1), F.lit("")).cast("int") * 60 + F.nullif(F.regexp_extract(c.cast("string"), r"[+-]\d\d:?(\d\d)$", 1), F.lit("")).cast("int")
    return Col(F.struct(to_timestamp(c, pattern).c.alias("instant"), F.coalesce(sign * offset, F.lit(0)).alias("offset_minutes")))
