"""Arrays, maps, variants, JSON and XML. Arrays count from 0."""

from __future__ import annotations

import pandas as pd

from lakeloom.functions.base import Any, Col, F, any_null, as_column, named, over_columns, spark

_VARIANT = {
    "array": "array<variant>", "binary": "binary", "boolean": "boolean", "char": "string", "varchar": "string", "date": "date", "double": "double", "real": "double", "integer": "bigint", "object": "map<string,variant>",
    "timestamp_ltz": "timestamp", "timestamp_ntz": "timestamp_ntz", "timestamp_tz": "timestamp", "time": "string",
}
_KINDS = {
    "array": "^ARRAY", "binary": "^BINARY$", "boolean": "^BOOLEAN$", "char": "^STRING$", "varchar": "^STRING$", "date": "^DATE$", "date_value": "^DATE$", "decimal": "^(DECIMAL|BIGINT)", "double": "^(DOUBLE|FLOAT|DECIMAL|BIGINT)",
    "real": "^(DOUBLE|FLOAT|DECIMAL|BIGINT)", "integer": "^BIGINT$", "object": "^OBJECT", "timestamp_ltz": "^TIMESTAMP$", "timestamp_tz": "^TIMESTAMP$", "timestamp_ntz": "^TIMESTAMP_NTZ$", "time": "^TIME$",
}

__all__ = [
    "array_append", "array_compact", "array_construct_compact", "array_contains", "array_except", "array_generate_range", "array_insert", "array_intersection", "array_join", "array_position", "array_prepend", "array_remove", "array_remove_at", "array_size",
    "array_slice", "array_sort", "array_to_string", "array_union", "arrays_to_object", "as_decimal", "as_number", "check_json", "check_xml", "element_at", "get", "get_ignore_case", "get_path", "map_cat", "map_contains_key", "map_delete",
    "map_insert", "map_pick", "object_construct", "object_construct_keep_null", "object_delete", "object_insert", "object_pick", "parse_json", "parse_xml", "sort_array", "strip_null_value", "to_array", "to_boolean", "to_char", "to_decimal", "to_double",
    "to_object", "to_varchar", "to_variant", "try_cast", "cast", "try_parse_json", "typeof", "xmlget", "get_json_object", "json_extract_path_text", *(f"as_{k}" for k in _VARIANT), *(f"is_{k}" for k in _KINDS),
]


def _guarded(kind: str):
    pattern, target = _KINDS[kind], _VARIANT[kind]

    def convert(c: Any) -> Col:
        """The value of a variant if it is of that kind, else null."""
        c = named(c)
        return Col(F.when(F.regexp_like(F.schema_of_variant(c), F.lit(pattern)), F.try_variant_get(c, "$", target)))

    convert.__name__ = f"as_{kind}"
    return convert


def _test(kind: str):
    def check(c: Any) -> Col:
        """True if a variant is of that kind."""
        return Col(F.regexp_like(F.schema_of_variant(named(c)), F.lit(_KINDS[kind])))

    check.__name__ = f"is_{kind}"
    return check


for _kind in _VARIANT:
    globals()[f"as_{_kind}"] = _guarded(_kind)
for _kind in _KINDS:
    globals()[f"is_{_kind}"] = _test(_kind)


def as_decimal(c: Any, precision: int = 38, scale: int = 0) -> Col:
    c = named(c)
    return Col(F.when(F.regexp_like(F.schema_of_variant(c), F.lit(_KINDS["decimal"])), F.try_variant_get(c, "$", f"decimal({precision},{scale})")))


as_number = as_decimal


def array_append(a: Any, x: Any) -> Col:
    return Col(F.array_append(named(a), as_column(x)))


def array_prepend(a: Any, x: Any) -> Col:
    return Col(F.array_prepend(named(a), as_column(x)))


@over_columns
def array_compact(a):
    return F.array_compact(a)


def array_construct_compact(*columns: Any) -> Col:
    return Col(F.array_compact(F.array(*[named(c) for c in columns])))


def array_contains(x: Any, a: Any) -> Col:
    """Whether the array (second argument) holds the value."""
    return Col(F.array_contains(named(a), as_column(x)))


def _times(a, x):
    return F.size(F.filter(a, lambda y: y.eqNullSafe(x)))


@over_columns
def array_except(a, b):
    """Multiset difference: each element of ``b`` takes one equal element of ``a`` away, first ones first."""
    seen = lambda i, x: _times(F.slice(a, F.lit(1), i + 1), x)
    return F.when(~any_null([a, b]), F.filter(a, lambda x, i: seen(i, x) > _times(b, x)))


@over_columns
def array_intersection(a, b):
    """Multiset intersection in the order of ``a``."""
    seen = lambda i, x: _times(F.slice(a, F.lit(1), i + 1), x)
    return F.when(~any_null([a, b]), F.filter(a, lambda x, i: seen(i, x) <= _times(b, x)))


@over_columns
def array_union(a, b):
    return F.array_union(a, b)


def array_generate_range(start: Any, stop: Any, step: Any = 1) -> Col:
    """From ``start`` up to and without ``stop``."""
    start, stop, step = (named(x) if isinstance(x, str) else as_column(x) for x in (start, stop, step))
    some = ((step > 0) & (start < stop)) | ((step < 0) & (start > stop))
    last = stop - F.signum(step).cast("int")
    return Col(F.when(some, F.sequence(start, last, step)).otherwise(F.array().cast("array<int>")))


def array_insert(a: Any, place: Any, x: Any) -> Col:
    """Insert before place ``place`` (from 0, negative from the end)."""
    place = as_column(place)
    a = named(a)
    at = F.when(place >= 0, place).otherwise(F.size(a) + place)
    return Col(F.concat(F.slice(a, F.lit(1), at), F.array(as_column(x)), F.slice(a, at + 1, F.greatest(F.size(a) - at, F.lit(0)))))


def array_join(a: Any, separator: str, null_replacement: str | None = None) -> Col:
    return Col(F.array_join(named(a), separator) if null_replacement is None else F.array_join(named(a), separator, null_replacement))


def array_to_string(a: Any, separator: Any) -> Col:
    separator = spark(separator)
    return Col(F.array_join(F.transform(named(a), lambda x: F.coalesce(x.cast("string"), F.lit(""))), separator) if isinstance(separator, str) else F.call_function("array_join", named(a), separator))


def array_position(x: Any, a: Any) -> Col:
    """Place from 0 of the first equal element; null if there is none."""
    return Col(F.nullif(F.array_position(named(a), as_column(x)), F.lit(0)) - 1)


def array_remove(a: Any, x: Any) -> Col:
    return Col(F.array_remove(named(a), as_column(x)))


def array_remove_at(a: Any, place: Any) -> Col:
    """Without the element at a place (from 0, negative from the end); unchanged if there is none."""
    a, place = named(a), as_column(place)
    at = F.when(place < 0, F.size(a) + place).otherwise(place)
    return Col(F.filter(a, lambda x, i: i != at))


@over_columns
def array_size(a):
    return F.array_size(a)


def array_slice(a: Any, start: Any, stop: Any) -> Col:
    """Elements from ``start`` to before ``stop``, from 0, negative from the end; null if an argument is."""
    a, start, stop = named(a), as_column(start), as_column(stop)
    n = F.size(a)
    begin = F.greatest(F.when(start < 0, n + start).otherwise(start), F.lit(0))
    end = F.least(F.when(stop < 0, n + stop).otherwise(stop), n)
    return Col(F.when(~any_null([a, start, stop]), F.slice(a, begin + 1, F.greatest(end - begin, F.lit(0)))))


def array_sort(a: Any, sort_ascending: bool = True, nulls_first: bool | None = None) -> Col:
    """Sorted; nulls come last ascending and first descending, unless said otherwise."""
    a = named(a)
    lead = (not sort_ascending) if nulls_first is None else nulls_first
    values = F.sort_array(F.filter(a, lambda x: x.isNotNull()), asc=sort_ascending)
    nulls = F.filter(a, lambda x: x.isNull())
    return Col(F.concat(nulls, values) if lead else F.concat(values, nulls))


def sort_array(a: Any, asc: bool = True) -> Col:
    return Col(F.sort_array(named(a), asc=asc))


def get(a: Any, key: Any) -> Col:
    """Element of an array (from 0), map or variant; null if there is none."""
    key = spark(key)
    return Col(F.get(named(a), F.lit(key)) if isinstance(key, int) else named(a)[key])


element_at = get


def json_extract_path_text(c: Any, path: Any) -> Col:
    """The value at a path (text or a column, such as ``a.b[0]``) of JSON text, as text."""
    path = as_column(path)
    rooted = F.when(path.startswith("$"), path).when(path.startswith("["), F.concat(F.lit("$"), path)).otherwise(F.concat(F.lit("$."), path))
    return Col(F.call_function("get_json_object", named(c), rooted))


def get_ignore_case(m: Any, key: str) -> Col:
    """Value of the key, else of the first one that differs in case only."""
    m = named(m)
    loose = F.map_values(F.map_filter(m, lambda k, _: F.lower(k) == key.lower()))
    return Col(F.coalesce(m[key], F.get(loose, F.lit(0))))


def get_path(v: Any, path: str) -> Col:
    return Col(F.try_variant_get(named(v), "$" + ("" if path.startswith("[") else ".") + path, "variant"))


def get_json_object(c: Any, path: str) -> Col:
    return Col(F.get_json_object(named(c), path if path.startswith("$") else "$." + path))


def _merged(m, keys_gone, *more):
    kept = F.map_filter(m, lambda k, _: ~keys_gone(k))
    return F.map_concat(kept, *more)


@over_columns
def map_cat(a, b):
    """Both maps; of a key in both, the second's value."""
    return _merged(a, lambda k: F.array_contains(F.map_keys(b), k), b)


def map_contains_key(key: Any, m: Any) -> Col:
    return Col(F.map_contains_key(named(m), as_column(key)))


def map_delete(m: Any, *keys: Any) -> Col:
    return Col(F.map_filter(named(m), lambda k, _: ~k.isin(*spark(keys))))


def map_pick(m: Any, *keys: Any) -> Col:
    flat = [k for x in keys for k in (x if isinstance(x, (list, tuple)) else [x])]
    return Col(F.map_filter(named(m), lambda k, _: k.isin(*spark(flat))))


def map_insert(m: Any, key: Any, value: Any, update: bool = False) -> Col:
    """The map with one more entry; a key that is there is an error unless ``update``."""
    m, key, value = named(m), as_column(key), as_column(value)
    new = _merged(m, lambda k: k == key, F.create_map(key, value))
    return Col(new if update else F.when(~F.map_contains_key(m, key), new).otherwise(F.raise_error(F.lit("key exists"))))


object_delete, object_pick, object_insert = map_delete, map_pick, map_insert


def object_construct_keep_null(*pairs: Any) -> Col:
    """A map of keys and values in turn."""
    return Col(F.create_map(*[named(p) for p in pairs]))


def object_construct(*pairs: Any) -> Col:
    """A map of keys and values in turn, without those whose key or value is null."""
    entries = [F.struct(named(k).alias("key"), named(v).alias("value")) for k, v in zip(pairs[0::2], pairs[1::2])]
    return Col(F.map_from_entries(F.filter(F.array(*entries), lambda e: e["key"].isNotNull() & e["value"].isNotNull())))


@over_columns
def arrays_to_object(keys, values):
    """A map of an array of keys and one of values, without null keys."""
    return F.map_from_entries(F.filter(F.arrays_zip(keys.alias("key"), values.alias("value")), lambda e: e["key"].isNotNull()))


@over_columns
def parse_json(c):
    """Text as a variant."""
    return F.parse_json(c)


@over_columns
def try_parse_json(c):
    return F.try_parse_json(c)


@over_columns
def check_json(c):
    """Null for valid JSON (and null), else a message."""
    return F.when(c.isNotNull() & F.try_parse_json(c).isNull(), F.lit("invalid JSON"))


@over_columns
def check_xml(c):
    """Null for well-formed XML (and null), else the parser's message."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        from xml.parsers import expat

        def one(text):
            if text is None:
                return None
            try:
                expat.ParserCreate().Parse(text, True)
            except expat.ExpatError as e:
                return str(e)
            return None

        return texts.map(one)

    return run(c)


def parse_xml(c: Any, schema: Any = None) -> Col:
    """Text as a struct of the schema, or as an unchanged document to be searched with ``xmlget`` and ``xpath``."""
    return Col(F.from_xml(named(c), schema) if schema is not None else named(c))


def xmlget(c: Any, tag: str, instance: int = 0) -> Col:
    """The text of the n-th child element (from 0) with a tag."""
    return Col(F.get(F.xpath(named(c), F.lit(f"/*/{tag}/text()")), F.lit(instance)))


@over_columns
def strip_null_value(v):
    """SQL null for a JSON null."""
    return F.when(~F.is_variant_null(v), v)


def to_array(c: Any, is_array: bool = False) -> Col:
    return Col(named(c) if is_array else F.array(named(c)))


@over_columns
def to_object(v):
    return F.try_variant_get(v, "$", "map<string,variant>")


def to_variant(c: Any) -> Col:
    """Any value as a variant."""
    return Col(F.get(F.expr("array(null)"), F.lit(0)) if c is None else named(c).cast("variant"))


@over_columns
def to_boolean(c):
    return c.cast("boolean")


@over_columns
def to_double(c):
    return c.cast("double")


def to_decimal(c: Any, precision: int = 38, scale: int = 0) -> Col:
    return Col(named(c).cast(f"decimal({precision},{scale})"))


def to_char(c: Any, pattern: str | None = None) -> Col:
    """Text of a value; with a format, of a date (``YYYY-MM-DD``) or number (``999.00``)."""
    from lakeloom.functions.datetimes import java_format

    if pattern is None:
        return Col(named(c).cast("string"))
    return Col(F.to_char(named(c), F.lit(pattern)) if set(pattern) <= set("0123456789.,$SGDMIPR") and "9" in pattern or "0" in pattern else F.date_format(named(c), java_format(pattern)))


to_varchar = to_char


def cast(c: Any, to: Any) -> Col:
    return Col(named(c).cast(to))


def try_cast(c: Any, to: Any) -> Col:
    return Col(named(c).try_cast(to))


@over_columns
def typeof(c):
    return F.typeof(c)
