"""Strings, binary data and regular expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql.types import IntegerType

from lakeloom.functions.base import Any, Col, F, any_null, as_column, named, over_columns, spark

__all__ = [
    "base64_decode_string", "base64_encode", "char", "charindex", "chr", "compress", "concat_ws", "decompress_binary", "decompress_string", "editdistance", "hex_decode_string", "hex_encode", "initcap",
    "insert", "jarowinkler_similarity", "md5_binary", "md5_number_lower64", "md5_number_upper64", "parse_url", "regexp_count", "regexp_extract", "regexp_instr", "regexp_like", "regexp_replace", "regexp_substr", "regexp_substr_all",
    "replace", "rtrimmed_length", "sha1_binary", "sha2", "sha2_binary", "soundex_p123", "space", "split", "split_part", "strtok", "strtok_to_array", "substr", "substring", "try_base64_decode_binary",
    "try_base64_decode_string", "try_hex_decode_binary", "try_hex_decode_string", "unicode", "left", "right", "lpad", "rpad", "trim", "ltrim", "rtrim", "contains", "startswith", "endswith", "repeat", "translate", "position", "locate",
]


def flags(parameters: str) -> str:
    """Inline flags of regex parameters: i (ignore case), m (multi-line), s (dot matches newlines); c and e are the default."""
    kept = "".join(p for p in "ims" if p in parameters)
    return f"(?{kept})" if kept else ""


def whole(pattern: Any, parameters: str = ""):
    """A pattern that must match the whole string."""
    pattern = spark(pattern)
    if isinstance(pattern, str):
        return F.lit(f"{flags(parameters)}^(?:{pattern})$")
    return F.concat(F.lit(flags(parameters) + "^(?:"), pattern, F.lit(")$"))


def _pattern(pattern: Any, parameters: str = ""):
    pattern = spark(pattern)
    return F.lit(flags(parameters) + pattern) if isinstance(pattern, str) else F.concat(F.lit(flags(parameters)), pattern)


def _text(value: Any):
    """A literal string, or a column."""
    value = spark(value)
    return F.lit(value) if isinstance(value, (str, int)) else value


@over_columns
def base64_decode_string(c):
    return F.unbase64(c).cast("string")


@over_columns
def base64_encode(c):
    return F.base64(c.cast("binary"))


def char(code: Any) -> Col:
    """The character of a Unicode code point."""
    code = named(code)
    return Col(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


chr = char


@over_columns
def unicode(c):
    """Code point of the first character; 0 of the empty string."""
    return F.when(c == "", 0).otherwise(F.conv(F.hex(F.encode(F.substring(c, 1, 1), "UTF-32")), 16, 10).cast("int"))


def charindex(target: Any, source: Any, position: Any = 1) -> Col:
    """Place from 1 of ``target`` at or after ``position``; 0 if there is none."""
    return Col(F.locate(target, named(source), position) if isinstance(target, str) and isinstance(position, int) else F.position(named(target), named(source), named(position) if isinstance(position, str) else as_column(position)))


position = charindex


def locate(target: Any, source: Any, position: Any = 1) -> Col:
    return charindex(F.lit(target) if isinstance(target, str) else target, source, position)


def _codec(action: str, result: str):
    @F.pandas_udf(result)
    def run(data: pd.Series, method: pd.Series) -> pd.Series:
        import bz2
        import zlib

        import pyarrow as pa

        def one(x, m):
            if x is None:
                return None
            m = m.lower().split("(")[0]
            x = x.encode() if isinstance(x, str) else bytes(x)
            if m in ("zlib", "deflate"):
                return zlib.compress(x) if action == "compress" else zlib.decompress(x)
            if m == "bzip2":
                return bz2.compress(x) if action == "compress" else bz2.decompress(x)
            if action == "compress":
                return len(x).to_bytes(8, "little") + pa.compress(x, codec=m, asbytes=True)
            return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec=m, asbytes=True)

        return pd.Series([one(x, m) for x, m in zip(data, method)])

    return run


def compress(data: Any, method: Any) -> Col:
    """Compress with zlib, bzip2, snappy, zstd, lz4 or gzip."""
    return Col(_codec("compress", "binary")(named(data).cast("binary"), _text(method)))


def decompress_binary(data: Any, method: Any) -> Col:
    return Col(_codec("decompress", "binary")(named(data), _text(method)))


def decompress_string(data: Any, method: Any) -> Col:
    return Col(_codec("decompress", "binary")(named(data), _text(method)).cast("string"))


def concat_ws(separator: Any, *columns: Any) -> Col:
    """Join with a separator; null if any argument is null."""
    columns = [named(c).cast("string") for c in columns]
    separator = _text(separator)
    parts = [x for c in columns for x in (separator, c)][1:]
    return Col(F.when(~any_null([separator, *columns]), F.concat(*parts)))


def contains(c: Any, part: Any) -> Col:
    return Col(F.contains(named(c), _text(part)))


def startswith(c: Any, part: Any) -> Col:
    return Col(F.startswith(named(c), _text(part)))


def endswith(c: Any, part: Any) -> Col:
    return Col(F.endswith(named(c), _text(part)))


def editdistance(a: Any, b: Any, most: int | None = None) -> Col:
    """Levenshtein distance; with ``most``, at most that."""
    distance = F.levenshtein(named(a), named(b))
    return Col(distance if most is None else F.least(distance, F.lit(most)))


@over_columns
def hex_decode_string(c):
    return F.unhex(c).cast("string")


def hex_encode(c: Any, upper: int = 1) -> Col:
    return Col(F.hex(named(c)) if upper else F.lower(F.hex(named(c))))


def initcap(c: Any, delimiters: str | None = None) -> Col:
    """Upper-case the first letter of each word and lower-case the rest; words end at any of the delimiters."""
    apart = re.escape(delimiters) if delimiters is not None else r"\s!?@\"^#$&~_,.:;+\-*%/|\\\[\](){}<>"
    words = F.regexp_extract_all(F.lower(named(c)), F.lit(f"[^{apart}]+|[{apart}]+" if apart else "(?s).+"), F.lit(0))
    return Col(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), ""))


def insert(base: Any, place: Any, length: Any, new: Any) -> Col:
    """Replace ``length`` characters from ``place`` (from 1)."""
    place, length = (as_column(x) for x in (place, length))
    base = named(base)
    return Col(F.concat(F.substr(base, F.lit(1), place - 1), named(new), F.substr(base, place + length)))


def left(c: Any, n: Any) -> Col:
    return Col(F.left(named(c), as_column(n)))


def right(c: Any, n: Any) -> Col:
    return Col(F.right(named(c), as_column(n)))


def lpad(c: Any, n: Any, pad: Any = " ") -> Col:
    return Col(F.lpad(named(c), as_column(n), _text(pad)))


def rpad(c: Any, n: Any, pad: Any = " ") -> Col:
    return Col(F.rpad(named(c), as_column(n), _text(pad)))


def trim(c: Any, characters: Any = None) -> Col:
    return Col(F.trim(named(c)) if characters is None else F.btrim(named(c), _text(characters)))


def ltrim(c: Any, characters: Any = None) -> Col:
    return Col(F.ltrim(named(c)) if characters is None else F.ltrim(named(c), _text(characters)))


def rtrim(c: Any, characters: Any = None) -> Col:
    return Col(F.rtrim(named(c)) if characters is None else F.rtrim(named(c), _text(characters)))


def repeat(c: Any, n: Any) -> Col:
    return Col(F.repeat(named(c), as_column(n)))


def translate(c: Any, source: Any, target: Any) -> Col:
    return Col(F.translate(named(c), spark(source), spark(target)))


@F.pandas_udf(IntegerType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        if x is None or y is None:
            return None
        x, y = x.lower(), y.lower()
        if not x or not y:
            return 0
        reach = max(len(x), len(y)) // 2 - 1
        used, matched = [False] * len(y), []
        for i, ch in enumerate(x):
            for j in range(max(0, i - reach), min(len(y), i + reach + 1)):
                if not used[j] and y[j] == ch:
                    used[j] = True
                    matched.append(ch)
                    break
        m = len(matched)
        if not m:
            return 0
        swaps = sum(p != q for p, q in zip(matched, (ch for ch, u in zip(y, used) if u))) / 2
        jaro = (m / len(x) + m / len(y) + (m - swaps) / m) / 3
        same = 0
        for p, q in zip(x[:4], y[:4]):
            if p != q:
                break
            same += 1
        return int((jaro + same * 0.1 * (1 - jaro)) * 100)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="Int32")


def jarowinkler_similarity(a: Any, b: Any) -> Col:
    """Similarity from 0 to 100, ignoring case."""
    return Col(_jaro_winkler(named(a), named(b)))


@over_columns
def md5_binary(c):
    return F.unhex(F.md5(c))


@over_columns
def md5_number_lower64(c):
    return F.conv(F.substring(F.md5(c), 17, 16), 16, 10).cast("decimal(20,0)")


@over_columns
def md5_number_upper64(c):
    return F.conv(F.substring(F.md5(c), 1, 16), 16, 10).cast("decimal(20,0)")


@over_columns
def sha1_binary(c):
    return F.unhex(F.sha1(c))


def sha2(c: Any, bits: int = 256) -> Col:
    return Col(F.sha2(named(c), bits))


def sha2_binary(c: Any, bits: int = 256) -> Col:
    return Col(F.unhex(F.sha2(named(c), bits)))


def parse_url(c: Any, permissive: int = 0) -> Col:
    """A map of a URL's parts: fragment, host, parameters (as JSON), path, port, query, scheme."""
    c, get = named(c), F.try_parse_url if permissive else F.parse_url
    port = F.regexp_extract(c, r"^[^:/?#]+://[^/?#]*?:(\d+)", 1)
    pairs = F.map_from_entries(F.transform(F.split(get(c, F.lit("QUERY")), "&"), lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_replace(p, "^[^=]*=?", ""))))
    return Col(
        F.create_map(
            F.lit("fragment"), get(c, F.lit("REF")), F.lit("host"), get(c, F.lit("HOST")), F.lit("parameters"), F.to_json(pairs),
            F.lit("path"), F.ltrim(get(c, F.lit("PATH")), F.lit("/")), F.lit("port"), F.nullif(port, F.lit("")), F.lit("query"), get(c, F.lit("QUERY")), F.lit("scheme"), get(c, F.lit("PROTOCOL")),
        )
    )


def _from(c: Any, place: Any):
    return named(c) if isinstance(place, int) and place == 1 else F.substr(named(c), as_column(place))


def regexp_count(c: Any, pattern: Any, place: Any = 1, parameters: str = "") -> Col:
    return Col(F.regexp_count(_from(c, place), _pattern(pattern, parameters)))


def regexp_extract(c: Any, pattern: str, group: int) -> Col:
    return Col(F.regexp_extract(named(c), pattern, group))


def regexp_like(c: Any, pattern: Any, parameters: str = "") -> Col:
    """True if the whole string matches."""
    return Col(F.regexp_like(named(c), whole(pattern, parameters)))


def regexp_replace(c: Any, pattern: Any, new: Any = "", place: Any = 1, occurrence: int = 0, parameters: str = "") -> Col:
    r"""Replace all matches, or the ``occurrence``-th, from ``place`` on; ``\1`` in the replacement is a group."""
    new = spark(new)
    groups = F.lit(re.sub(r"\\(\d)", r"$\1", new)) if isinstance(new, str) else new
    if place == 1 and occurrence == 0:
        return Col(F.regexp_replace(named(c), _pattern(pattern, parameters), groups))
    column, found = _from(c, place), _pattern(pattern, parameters)
    head = F.lit("") if place == 1 else F.substr(named(c), F.lit(1), as_column(place) - 1)
    if occurrence == 0:
        return Col(F.concat(head, F.regexp_replace(column, found, groups)))
    matches = F.regexp_extract_all(column, F.concat(F.lit("(?s:"), found, F.lit(")")), F.lit(0))
    parts = F.split(column, pattern if isinstance(pattern, str) else found, -1)
    joined = F.transform(parts, lambda p, i: F.concat(p, F.when(i + 1 == occurrence, F.regexp_replace(F.get(matches, i), found, groups)).otherwise(F.coalesce(F.get(matches, i), F.lit("")))))
    return Col(F.concat(head, F.array_join(joined, "")))


def regexp_substr(c: Any, pattern: Any, place: Any = 1, occurrence: int = 1, parameters: str = "", group: int | None = None) -> Col:
    """The ``occurrence``-th match, or null."""
    all_matches = F.regexp_extract_all(_from(c, place), _pattern(pattern, parameters), F.lit(group or (1 if "e" in parameters else 0)))
    return Col(F.get(all_matches, F.lit(occurrence - 1)))


def regexp_substr_all(c: Any, pattern: Any, place: Any = 1, occurrence: int = 1, parameters: str = "", group: int | None = None) -> Col:
    """All matches from the ``occurrence``-th on; whole ones unless a group is named."""
    all_matches = F.regexp_extract_all(_from(c, place), _pattern(pattern, parameters), F.lit(group or (1 if "e" in parameters else 0)))
    return Col(F.slice(all_matches, occurrence, F.greatest(F.size(all_matches), F.lit(1))))


def regexp_instr(c: Any, pattern: Any, place: int = 1, occurrence: int = 1, after: int = 0, parameters: str = "") -> Col:
    """Place from 1 of the ``occurrence``-th match (with ``after``, of what follows it); 0 if there is none."""
    column, found = _from(c, place), _pattern(pattern, parameters)
    matches = F.regexp_extract_all(column, found, F.lit(0))
    parts = F.split(column, (flags(parameters) + pattern) if isinstance(pattern, str) else found, -1)
    begins = F.aggregate(F.slice(parts, 1, occurrence), F.lit(0), lambda n, p: n + F.length(p)) + F.aggregate(F.slice(matches, 1, occurrence - 1), F.lit(0), lambda n, m: n + F.length(m))
    size = F.length(F.get(matches, F.lit(occurrence - 1)))
    return Col(F.when(F.size(matches) < occurrence, 0).otherwise(begins + place + (size if after else 0)))


def replace(c: Any, old: Any, new: Any = "") -> Col:
    return Col(F.replace(named(c), _text(old), _text(new)))


@over_columns
def rtrimmed_length(c):
    return F.length(F.rtrim(c))


@over_columns
def soundex_p123(c):
    """Soundex in which a letter after one with the same code counts again if the first was the initial."""
    rest = F.translate(F.upper(F.substr(c, F.lit(2))), "BFPVCGJKQSXZDTLMNRAEIOUYHW", "11112222222233455600000099")
    coded = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "9", ""), r"(\d)\1+", "$1"), "0", "")
    return F.rpad(F.concat(F.upper(F.substring(c, 1, 1)), coded), 4, "0")


def space(n: Any) -> Col:
    return Col(F.repeat(F.lit(" "), as_column(n)))


def split(c: Any, separator: Any) -> Col:
    """Split at a literal separator."""
    separator = spark(separator)
    return Col(F.split(named(c), re.escape(separator) if isinstance(separator, str) else F.concat(F.lit("\\Q"), separator, F.lit("\\E")), -1))


def split_part(c: Any, separator: Any, part: Any) -> Col:
    """The n-th part, from 1 (0 counts as 1), negative from the end; empty beyond."""
    part = as_column(part)
    return Col(F.split_part(named(c), _text(separator), F.when(part == 0, F.lit(1)).otherwise(part)))


def strtok_to_array(c: Any, delimiters: Any = " ") -> Col:
    """Parts between any of the delimiter characters (text or a column), without empty ones."""
    delimiters = spark(delimiters)
    if isinstance(delimiters, str):
        apart = F.lit("[" + re.escape(delimiters) + "]")
    else:
        apart = F.concat(F.lit("["), F.regexp_replace(delimiters, r"([\\\[\]^&-])", r"\\$1"), F.lit("]"))
    return Col(F.filter(F.split(named(c), apart, -1), lambda x: x != ""))


def strtok(c: Any, delimiters: Any = " ", part: int = 1) -> Col:
    return Col(F.get(strtok_to_array(c, delimiters).c, F.lit(part - 1)))


def substring(c: Any, start: Any, length: Any = None) -> Col:
    """From ``start`` (from 1; negative from the end)."""
    return Col(F.substr(named(c), as_column(start)) if length is None else F.substr(named(c), as_column(start), as_column(length)))


substr = substring


@over_columns
def try_base64_decode_binary(c):
    return F.try_to_binary(c, F.lit("base64"))


@over_columns
def try_base64_decode_string(c):
    return F.try_to_binary(c, F.lit("base64")).cast("string")


@over_columns
def try_hex_decode_binary(c):
    return F.try_to_binary(c, F.lit("hex"))


@over_columns
def try_hex_decode_string(c):
    return F.try_to_binary(c, F.lit("hex")).cast("string")
