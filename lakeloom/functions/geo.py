"""Geospatial functions over shapes in WKT.

A shape is text such as ``POINT(1 2)``; longitude comes first. Functions run as
Arrow-batched pandas UDFs over a small parser. Distances, lengths and areas of
geographies are on a sphere of 6371 km, in metres. H3 functions need the ``h3``
library, which may be absent.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, StringType

from lakeloom.functions.base import Any, Col, F, named

__all__ = [
    "st_area", "st_asgeojson", "st_astext", "st_aswkt", "st_aswkb", "st_azimuth", "st_centroid", "st_collect", "st_contains", "st_coveredby", "st_covers", "st_dimension", "st_disjoint", "st_distance", "st_dwithin", "st_endpoint", "st_envelope",
    "st_geogfromtext", "st_geogfromwkt", "st_geographyfromtext", "st_geographyfromwkt", "st_geogpointfromgeohash", "st_geohash", "st_geometryfromtext", "st_geometryfromwkt", "st_geomfromtext", "st_geomfromwkt", "st_intersects", "st_isvalid", "st_length", "st_makegeompoint",
    "st_makeline", "st_makepoint", "st_makepolygon", "st_npoints", "st_numpoints", "st_perimeter", "st_pointn", "st_startpoint", "st_within", "st_x", "st_xmax", "st_xmin", "st_y", "st_ymax", "st_ymin", "to_geography", "to_geometry",
    "try_to_geography", "try_to_geometry", "h3_latlng_to_cell", "h3_cell_to_parent", "h3_get_resolution",
]

TYPES = {"binary": BinaryType(), "boolean": BooleanType(), "double": DoubleType(), "int": IntegerType(), "string": StringType()}
RADIUS = 6_371_000.0
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def parse(text: str) -> dict:
    """GeoJSON-like dict of WKT, EWKT or GeoJSON text."""
    text = text.strip()
    if text.startswith("{"):
        return json.loads(text)
    text = re.sub(r"^SRID=\d+;", "", text, flags=re.I)
    m = re.match(r"([A-Za-z]+)\s*(.*)$", text, re.S)
    kind = {k.lower(): k for k in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")}[m[1].lower()]
    body = re.sub(r"(-?[\d.]+(?:[eE][-+]?\d+)?)\s+(-?[\d.]+(?:[eE][-+]?\d+)?)", r"[\1,\2]", m[2].strip())
    coordinates = json.loads(body.replace("(", "[").replace(")", "]"))
    if kind == "Point":
        coordinates = coordinates[0]
    elif kind == "MultiPoint":
        coordinates = [c[0] if isinstance(c[0], list) else c for c in coordinates]
    return {"type": kind, "coordinates": coordinates}


def wkt(shape: dict) -> str:
    def numbers(c):
        return " ".join(f"{x:.15g}" for x in c) if not isinstance(c[0], list) else ",".join(numbers(x) if not isinstance(x[0], list) else f"({numbers(x)})" for x in c)

    return f"{shape['type'].upper()}({numbers(shape['coordinates'])})"


def points(shape: dict) -> list:
    def walk(c):
        if isinstance(c[0], list):
            for x in c:
                yield from walk(x)
        else:
            yield c

    return list(walk(shape["coordinates"]))


def rings(shape: dict) -> list:
    return shape["coordinates"] if shape["type"] == "Polygon" else [r for p in shape["coordinates"] for r in p] if shape["type"] == "MultiPolygon" else []


def metres(a, b) -> float:
    o1, a1, o2, a2 = (math.radians(x) for x in (*a[:2], *b[:2]))
    h = math.sin((a2 - a1) / 2) ** 2 + math.cos(a1) * math.cos(a2) * math.sin((o2 - o1) / 2) ** 2
    return 2 * RADIUS * math.asin(min(1.0, math.sqrt(h)))


def _length(shape: dict, kinds: tuple) -> float:
    if shape["type"] not in kinds:
        return 0.0
    lines = rings(shape) or ([shape["coordinates"]] if shape["type"] == "LineString" else shape["coordinates"])
    return sum(metres(a, b) for line in lines for a, b in zip(line, line[1:]))


def _area(shape: dict) -> float:
    total = 0.0
    for i, ring in enumerate(rings(shape)):
        part = sum(math.radians(b[0] - a[0]) * (2 + math.sin(math.radians(a[1])) + math.sin(math.radians(b[1]))) for a, b in zip(ring, ring[1:]))
        total += abs(part) * RADIUS * RADIUS / 2 * (1 if i == 0 or shape["type"] != "Polygon" else -1)
    return total


def _inside(p, shape: dict) -> bool:
    odd = False
    for ring in rings(shape):
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if min(x1, x2) <= p[0] <= max(x1, x2) and min(y1, y2) <= p[1] <= max(y1, y2) and (x2 - x1) * (p[1] - y1) == (y2 - y1) * (p[0] - x1):
                return True
            if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def _covers(a: dict, b: dict) -> bool:
    return all(_inside(p, a) for p in points(b)) if rings(a) else set(map(tuple, points(b))) <= set(map(tuple, points(a)))


def _edges(shape: dict):
    lines = rings(shape) or ([shape["coordinates"]] if shape["type"] == "LineString" else [])
    return [(a, b) for line in lines for a, b in zip(line, line[1:])]


def _cross(a, b, c, d) -> bool:
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0


def _intersects(a: dict, b: dict) -> bool:
    return any(_inside(p, a) for p in points(b)) or any(_inside(p, b) for p in points(a)) or bool(set(map(tuple, points(a))) & set(map(tuple, points(b)))) or any(_cross(*e, *f) for e in _edges(a) for f in _edges(b))


def _centroid(shape: dict) -> dict:
    if rings(shape):
        ring, area, x, y = rings(shape)[0], 0.0, 0.0, 0.0
        for a, b in zip(ring, ring[1:]):
            w = a[0] * b[1] - b[0] * a[1]
            area, x, y = area + w, x + (a[0] + b[0]) * w, y + (a[1] + b[1]) * w
        if area:
            return {"type": "Point", "coordinates": [x / (3 * area), y / (3 * area)]}
    ps = points(shape)
    return {"type": "Point", "coordinates": [sum(p[0] for p in ps) / len(ps), sum(p[1] for p in ps) / len(ps)]}


def _geohash(shape: dict, n: int = 20) -> str:
    p = _centroid(shape)["coordinates"]
    low, high, out, bits, even = [-180.0, -90.0], [180.0, 90.0], "", 0, True
    for i in range(5 * n):
        axis = 0 if even else 1
        middle = (low[axis] + high[axis]) / 2
        bits = bits << 1 | (p[axis] >= middle)
        (low if p[axis] >= middle else high)[axis] = middle
        even = not even
        if i % 5 == 4:
            out, bits = out + GEOHASH[bits], 0
    return out


def _from_geohash(code: str) -> dict:
    low, high, even = [-180.0, -90.0], [180.0, 90.0], True
    for ch in code.lower():
        for bit in f"{GEOHASH.index(ch):05b}":
            axis = 0 if even else 1
            (low if bit == "1" else high)[axis] = (low[axis] + high[axis]) / 2
            even = not even
    return {"type": "Point", "coordinates": [(low[0] + high[0]) / 2, (low[1] + high[1]) / 2]}


def _udf(function, result: str, shapes: int = 1):
    """A column function whose first ``shapes`` arguments are shapes; null in, null out."""

    @F.pandas_udf(TYPES[result])
    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns):
            if any(v is None for v in row):
                out.append(None)
                continue
            value = function(*[parse(v) for v in row[:shapes]], *row[shapes:])
            out.append(wkt(value) if isinstance(value, dict) else value)
        return pd.Series(out, dtype=object)

    def call(*args: Any) -> Col:
        return Col(run(*[named(a) if isinstance(a, (str, Col)) or not isinstance(a, (int, float)) else F.lit(a) for a in args]))

    return call


def _valid(text: str):
    try:
        return wkt(parse(text))
    except (KeyError, ValueError, IndexError, TypeError):
        return None


to_geography = to_geometry = st_geogfromtext = st_geogfromwkt = st_geographyfromtext = st_geographyfromwkt = st_geometryfromtext = st_geometryfromwkt = st_geomfromtext = st_geomfromwkt = st_astext = st_aswkt = _udf(lambda s: s, "string")
try_to_geography = try_to_geometry = _udf(_valid, "string", 0)
st_isvalid = _udf(lambda t: _valid(t) is not None, "boolean", 0)
st_asgeojson = _udf(lambda s: json.dumps(s, separators=(",", ":")), "string")
st_aswkb = _udf(lambda s: __import__("struct").pack("<BIdd", 1, 1, *map(float, s["coordinates"])) if s["type"] == "Point" else None, "binary")
st_area = _udf(_area, "double")
st_length = _udf(lambda s: _length(s, ("LineString", "MultiLineString")), "double")
st_perimeter = _udf(lambda s: _length(s, ("Polygon", "MultiPolygon")), "double")
st_npoints = st_numpoints = _udf(lambda s: len(points(s)), "int")
st_dimension = _udf(lambda s: 0 if "Point" in s["type"] else 1 if "Line" in s["type"] else 2, "int")
st_centroid = _udf(_centroid, "string")
st_startpoint = _udf(lambda s: {"type": "Point", "coordinates": points(s)[0]}, "string")
st_endpoint = _udf(lambda s: {"type": "Point", "coordinates": points(s)[-1]}, "string")
st_pointn = _udf(lambda s, n: {"type": "Point", "coordinates": points(s)[n - 1 if n > 0 else n]}, "string")
st_x = _udf(lambda s: float(s["coordinates"][0]), "double")
st_y = _udf(lambda s: float(s["coordinates"][1]), "double")
st_xmin = _udf(lambda s: float(min(p[0] for p in points(s))), "double")
st_xmax = _udf(lambda s: float(max(p[0] for p in points(s))), "double")
st_ymin = _udf(lambda s: float(min(p[1] for p in points(s))), "double")
st_ymax = _udf(lambda s: float(max(p[1] for p in points(s))), "double")
st_distance = _udf(lambda a, b: 0.0 if _intersects(a, b) else min(metres(p, q) for p in points(a) for q in points(b)), "double", 2)
st_dwithin = _udf(lambda a, b, d: _intersects(a, b) or min(metres(p, q) for p in points(a) for q in points(b)) <= d, "boolean", 2)
st_azimuth = _udf(lambda a, b: math.atan2(math.sin(math.radians(b["coordinates"][0] - a["coordinates"][0])) * math.cos(math.radians(b["coordinates"][1])), math.cos(math.radians(a["coordinates"][1])) * math.sin(math.radians(b["coordinates"][1])) - math.sin(math.radians(a["coordinates"][1])) * math.cos(math.radians(b["coordinates"][1])) * math.cos(math.radians(b["coordinates"][0] - a["coordinates"][0]))) % (2 * math.pi), "double", 2)
st_contains = st_covers = _udf(_covers, "boolean", 2)
st_within = st_coveredby = _udf(lambda a, b: _covers(b, a), "boolean", 2)
st_intersects = _udf(_intersects, "boolean", 2)
st_disjoint = _udf(lambda a, b: not _intersects(a, b), "boolean", 2)
st_envelope = _udf(lambda s: (lambda x, y: {"type": "Polygon", "coordinates": [[[min(x), min(y)], [max(x), min(y)], [max(x), max(y)], [min(x), max(y)], [min(x), min(y)]]]})([p[0] for p in points(s)], [p[1] for p in points(s)]), "string")
st_makeline = _udf(lambda a, b: {"type": "LineString", "coordinates": points(a) + points(b)}, "string", 2)
st_makepolygon = _udf(lambda s: {"type": "Polygon", "coordinates": [points(s)]}, "string")
st_collect = _udf(lambda a, b: {"type": "MultiPoint", "coordinates": points(a) + points(b)}, "string", 2)
st_geohash = _udf(lambda s, *n: _geohash(s, *n), "string")
st_geogpointfromgeohash = _udf(_from_geohash, "string", 0)


def st_makepoint(longitude: Any, latitude: Any) -> Col:
    text = lambda c: F.regexp_replace(named(c).cast("double").cast("string"), r"\.0$", "")
    return Col(F.concat(F.lit("POINT("), text(longitude), F.lit(" "), text(latitude), F.lit(")")))


st_makegeompoint = st_makepoint


def _from_wkb(data: bytes) -> dict:
    """A shape of little- or big-endian WKB or EWKB."""
    import struct

    def read(at: int) -> tuple[dict, int]:
        order = "<" if data[at] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5 + (4 if kind & 0x20000000 else 0)
        kind &= 0xFF

        def numbers(at: int, n: int) -> tuple[list, int]:
            return [list(struct.unpack_from(order + "dd", data, at + 16 * i)) for i in range(n)], at + 16 * n

        def counted(at: int) -> tuple[list, int]:
            return numbers(at + 4, struct.unpack_from(order + "I", data, at)[0])

        if kind == 1:
            points_, at = numbers(at, 1)
            return {"type": "Point", "coordinates": points_[0]}, at
        if kind == 2:
            points_, at = counted(at)
            return {"type": "LineString", "coordinates": points_}, at
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        parts = []
        for _ in range(n):
            part, at = counted(at) if kind == 3 else read(at)
            parts.append(part if kind == 3 else part["coordinates"])
        return {"type": {3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}[kind], "coordinates": parts}, at

    return read(0)[0]


def _cell(code: str) -> dict:
    """The rectangle of a geohash."""
    low, high, even = [-180.0, -90.0], [180.0, 90.0], True
    for ch in code.lower():
        for bit in f"{GEOHASH.index(ch):05b}":
            axis = 0 if even else 1
            (low if bit == "1" else high)[axis] = (low[axis] + high[axis]) / 2
            even = not even
    (x1, y1), (x2, y2) = low, high
    return {"type": "Polygon", "coordinates": [[[x1, y1], [x2, y1], [x2, y2], [x1, y2], [x1, y1]]]}


def _simplify(shape: dict, tolerance: float) -> dict:
    """Leave out points of a line or ring that lie within the tolerance (metres) of the line between those kept."""

    def thin(line: list) -> list:
        if len(line) < 3:
            return line
        scale = math.cos(math.radians(line[0][1])) * 111_195
        flat = [(x * scale, y * 111_195) for x, y in line]
        (ax, ay), (bx, by) = flat[0], flat[-1]
        base = math.hypot(bx - ax, by - ay)
        far = [abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / base if base else math.hypot(x - ax, y - ay) for x, y in flat[1:-1]]
        at = max(range(len(far)), key=far.__getitem__)
        return thin(line[: at + 2])[:-1] + thin(line[at + 1 :]) if far[at] > tolerance else [line[0], line[-1]]

    if shape["type"] == "LineString":
        return {"type": "LineString", "coordinates": thin(shape["coordinates"])}
    if shape["type"] == "Polygon":
        return {"type": "Polygon", "coordinates": [r if len(t := thin(r[: len(r) // 2 + 1])[:-1] + thin(r[len(r) // 2 :])) < 4 else t for r in shape["coordinates"]]}
    return shape


def _interpolate(shape: dict, share: float) -> dict:
    """The point at a share of a line's length."""
    line = shape["coordinates"]
    left = share * sum(metres(a, b) for a, b in zip(line, line[1:]))
    for a, b in zip(line, line[1:]):
        d = metres(a, b)
        if left <= d:
            f = left / d if d else 0.0
            return {"type": "Point", "coordinates": [a[0] + (b[0] - a[0]) * f, a[1] + (b[1] - a[1]) * f]}
        left -= d
    return {"type": "Point", "coordinates": line[-1]}


def _oriented(shape: dict) -> dict:
    """The polygon of a line, its ring as given."""
    return {"type": "Polygon", "coordinates": [points(shape)]}


def _hausdorff(a: dict, b: dict) -> float:
    """Largest distance, in degrees, of a point of one shape to the nearest point of the other."""
    gap = lambda p, q: math.hypot(p[0] - q[0], p[1] - q[1])
    return max(max(min(gap(p, q) for q in points(y)) for p in points(x)) for x, y in ((a, b), (b, a)))


st_geogfromewkt = st_geographyfromewkt = st_geomfromewkt = st_geometryfromewkt = to_geography
ST_GEOGFROMWKB = ST_GEOGFROMEWKB = ST_GEOGRAPHYFROMEWKB = st_geographyfromwkb = st_geomfromwkb = st_geomfromewkb = st_geometryfromwkb = st_geometryfromewkb = _udf(lambda d: _from_wkb(bytes(d)), "string", 0)
st_asewkt = _udf(lambda s: "SRID=4326;" + wkt(s), "string")
st_asewkb = _udf(lambda s: __import__("struct").pack("<BIIdd", 1, 1 | 0x20000000, 4326, *map(float, s["coordinates"])) if s["type"] == "Point" else None, "binary")
st_geogfromgeohash = st_geomfromgeohash = _udf(_cell, "string", 0)
st_geompointfromgeohash = st_geogpointfromgeohash
st_simplify = _udf(_simplify, "string")
st_interpolate = _udf(_interpolate, "string")
st_makepolygonoriented = _udf(_oriented, "string")
st_hausdorffdistance = _udf(_hausdorff, "double", 2)
__all__ += ["st_geogfromewkt", "st_geographyfromewkt", "st_geomfromewkt", "st_geometryfromewkt", "ST_GEOGFROMWKB", "ST_GEOGFROMEWKB", "ST_GEOGRAPHYFROMEWKB", "st_geographyfromwkb", "st_geomfromwkb", "st_geomfromewkb", "st_geometryfromwkb", "st_geometryfromewkb"]
__all__ += ["st_asewkt", "st_asewkb", "st_geogfromgeohash", "st_geomfromgeohash", "st_geompointfromgeohash", "st_simplify", "st_interpolate", "st_makepolygonoriented", "st_hausdorffdistance"]

def _h3(name: str, result: str):
    def call(*args: Any) -> Col:
        try:
            import h3
        except ImportError as e:
            raise NotImplementedError("H3 functions need the h3 library") from e
        function = getattr(h3, name)

        @F.pandas_udf(result)
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series([None if any(v is None for v in row) else function(*row) for row in zip(*columns)])

        return Col(run(*[named(a) if not isinstance(a, (int, float)) else F.lit(a) for a in args]))

    return call


#: Functions of the ``h3`` library by name: its own name and the result's type (fixed values).
H3 = {
    "h3_latlng_to_cell": ("latlng_to_cell", "string"), "h3_latlng_to_cell_string": ("latlng_to_cell", "string"), "h3_cell_to_parent": ("cell_to_parent", "string"), "h3_cell_to_children": ("cell_to_children", "array<string>"),
    "h3_cell_to_children_string": ("cell_to_children", "array<string>"), "h3_get_resolution": ("get_resolution", "int"), "h3_grid_disk": ("grid_disk", "array<string>"), "h3_grid_distance": ("grid_distance", "int"),
    "h3_grid_path": ("grid_path_cells", "array<string>"), "h3_int_to_string": ("int_to_str", "string"), "h3_string_to_int": ("str_to_int", "bigint"), "h3_is_pentagon": ("is_pentagon", "boolean"), "h3_is_valid_cell": ("is_valid_cell", "boolean"),
    "h3_compact_cells": ("compact_cells", "array<string>"), "h3_uncompact_cells": ("uncompact_cells", "array<string>"),
}
for _name, (_function, _type) in H3.items():
    globals()[_name] = _h3(_function, _type)
__all__ += [n for n in H3 if n not in __all__]
