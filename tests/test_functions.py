import datetime

import duckdb
import pandas as pd
import pytest

from lakeloom import Session
from lakeloom import functions as L
from lakeloom.functions import col, lit
from lakeloom.plans import registry


@pytest.fixture(scope="module")
def one(spark):
    session = Session(spark)
    return session.create_dataframe([("apple banana", [1, 2, 3], [5, None, 2], datetime.datetime(2024, 2, 29, 13, 45, 7), 15, 26, "https://user.example.com:8080/a/b?x=1&y=2#top")], "s string, a array<int>, n array<int>, t timestamp_ntz, i int, j int, u string")


def value(frame, expression):
    return frame.select(expression.as_("x")).collect()[0][0]


CASES = [
    (lambda: L.charindex("an", "s"), 8), (lambda: L.charindex("an", "s", 9), 10), (lambda: L.initcap("s"), "Apple Banana"), (lambda: L.insert("s", 1, 5, lit("pear")), "pear banana"), (lambda: L.strtok("s", " p", 2), "le"), (lambda: L.split_part("s", " ", 0), "apple"),
    (lambda: L.regexp_substr("s", "[an]+", 1, 2), "anana"), (lambda: L.regexp_instr("s", "n"), 9), (lambda: L.regexp_instr("s", "n", 1, 2, 1), 12), (lambda: L.regexp_replace("s", "a(n)", r"<\1>", 1, 2), "apple ban<n>a".replace("ban<n>a", "ban<n>a")),
    (lambda: L.regexp_like("s", "apple"), False), (lambda: L.regexp_like("s", "APPLE.*", "i"), True), (lambda: L.unicode("s"), 97), (lambda: L.char(lit(8364)), "€"), (lambda: L.jarowinkler_similarity("s", "s"), 100), (lambda: L.space(3), "   "), (lambda: L.hex_decode_string(L.hex_encode("s")), "apple banana"),
    (lambda: L.decompress_string(L.compress("s", "zstd"), "zstd"), "apple banana"), (lambda: L.concat_ws("-", "s", lit(None).cast("string")), None), (lambda: L.editdistance("s", lit("apple")), 7), (lambda: L.rtrimmed_length(lit("ab  ")), 2), (lambda: L.get(L.parse_url("u"), "port"), "8080"),
    (lambda: L.array_position(lit(2), "a"), 1), (lambda: L.array_position(lit(9), "a"), None), (lambda: L.array_slice("a", 1, 2), [2]), (lambda: L.array_slice("a", 0, -1), [1, 2]), (lambda: L.array_insert("a", 1, 9), [1, 9, 2, 3]), (lambda: L.array_remove_at("a", -1), [1, 2]),
    (lambda: L.array_sort("n"), [2, 5, None]), (lambda: L.array_sort("n", False), [None, 5, 2]), (lambda: L.array_generate_range(lit(2), lit(8), lit(3)), [2, 5]), (lambda: L.array_except(L.array(lit(1), lit(1), lit(2)), L.array(lit(1))), [1, 2]), (lambda: L.array_intersection(L.array(lit(1), lit(1), lit(2)), L.array(lit(1), lit(2))), [1, 2]),
    (lambda: L.array_contains(lit(3), "a"), True), (lambda: L.object_construct(lit("p"), lit(1), lit("q"), lit(None).cast("int")), {"p": 1}), (lambda: L.map_cat(L.create_map(lit("a"), lit(1)), L.create_map(lit("a"), lit(2))), {"a": 2}), (lambda: L.map_delete(L.create_map(lit("a"), lit(1)), "a"), {}),
    (lambda: L.as_integer(L.parse_json(lit("5"))), 5), (lambda: L.as_varchar(L.parse_json(lit("5"))), None), (lambda: L.is_object(L.parse_json(lit('{"a":1}'))), True), (lambda: L.check_json(lit("{")), "invalid JSON"), (lambda: L.xmlget(lit("<a><b>1</b><b>2</b></a>"), "b", 1), "2"), (lambda: L.check_xml(lit("<a/>")), None),
    (lambda: L.greatest("i", "j"), 26), (lambda: L.least("i", lit(None).cast("int")), None), (lambda: L.decode("i", lit(15), lit("x"), lit("y")), "x"), (lambda: L.div0("i", lit(0)), 0.0), (lambda: L.truncate(lit(-7.89), 1), -7.8), (lambda: L.bitshiftleft(col("i"), 2), 60), (lambda: L.getbit("i", lit(1)), 1),
    (lambda: L.haversine(lit(40.7127), lit(-74.0059), lit(34.0500), lit(-118.2500)), pytest.approx(3936.4, abs=1)), (lambda: L.datediff("month", lit("2023-01-31").cast("timestamp_ntz"), "t"), 13), (lambda: L.datediff("hour", lit("2024-02-29 12:59:59").cast("timestamp_ntz"), "t"), 1), (lambda: L.datediff("week", lit("2024-02-25").cast("date"), "t"), 1),
    (lambda: L.add_months("t", 1), datetime.date(2024, 3, 31)), (lambda: L.date_from_parts(lit(2024), lit(13), lit(0)), datetime.date(2024, 12, 31)), (lambda: L.previous_day("t", "thu"), datetime.date(2024, 2, 22)), (lambda: L.dayofweek("t"), 4), (lambda: L.date_format("t", "YYYY-MM-DD HH24:MI"), "2024-02-29 13:45"), (lambda: L.last_day("t", "quarter"), datetime.date(2024, 3, 31)),
    (lambda: L.time_slice("t", 15, "minute"), datetime.datetime(2024, 2, 29, 13, 45)), (lambda: L.st_distance(L.st_makepoint(lit(0), lit(0)), L.st_makepoint(lit(0), lit(1))), pytest.approx(111195, abs=5)), (lambda: L.st_contains(lit("POLYGON((0 0,4 0,4 4,0 4,0 0))"), lit("POINT(1 1)")), True), (lambda: L.st_x(lit("POINT(3 4)")), 3.0), (lambda: L.st_geohash(lit("POINT(-122.3061 37.5542)"), 6), "9q9j8u"),
    (lambda: L.regexp_substr_all("s", "[an]+"), ["a", "anana"]), (lambda: L.regexp_substr_all("s", "[an]+", 1, 2), ["anana"]), (lambda: L.json_extract_path_text(lit('{"a": {"b": [7]}}'), "a.b[0]"), "7"), (lambda: L.json_extract_path_text(lit('{"a": 5}'), lit("a")), "5"),
    (lambda: L.strtok("s", lit(" p"), 2), "le"), (lambda: L.strtok_to_array(lit("a-b]c"), lit("-]")), ["a", "b", "c"]), (lambda: L.in_(["i", "j"], [[1, 2], [15, 26]]), True), (lambda: L.in_(["i", "j"], [[26, 15]]), False), (lambda: L.uniform(lit(3), lit(3)), 3), (lambda: L.time_from_parts(lit(1), lit(2), lit(3)), "01:02:03"),
    (lambda: L.fl_get_file_type(lit("a/b.PNG")), "image"), (lambda: L.prompt("hi {0}", "i"), "hi 15"), (lambda: L.vector_cosine_distance(L.array(lit(1.0), lit(0.0)), L.array(lit(1.0), lit(0.0))), 1.0), (lambda: L.split_text_recursive_character("s", 6), ["apple", "banana"]),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_function(one, n):
    make, expected = CASES[n]
    assert value(one, make()) == expected


def test_percentiles_of_combined_states_are_exact(spark):
    """More values than a sketch of the default size holds, in states of unequal sizes, one of them empty."""
    values = [(k * 7919) % 3001 / 4 for k in range(3001)]
    rows = [(k % 7 * (k % 3), v) for k, v in enumerate(values)] + [(99, None)]
    states = Session(spark).create_dataframe(rows, "g int, v double").group_by("g").agg(L.approx_percentile_accumulate("v").as_("state"))
    shares = [0.0, 0.07, 0.25, 0.5, 0.999, 1.0]
    whole = states.agg(L.approx_percentile_combine("state").as_("state")).select(*[L.approx_percentile_estimate("state", f).as_(f"p{i}") for i, f in enumerate(shares)])
    assert list(whole.collect()[0]) == [0.0, 52.5, 187.5, 375.0, 749.25, 750.0]
    assert states.filter(col("g") == 99).select(L.approx_percentile_estimate("state", 0.5).as_("p")).collect()[0][0] is None
    hundred = Session(spark).create_dataframe([(float(k),) for k in range(1, 101)], "v double").agg(L.approx_percentile_accumulate("v").as_("state"))
    assert hundred.select(L.approx_percentile_estimate("state", 0.07).as_("p")).collect()[0][0] == 7.0


def test_collecting_aggregates_over_more_keys_than_a_bitmap_holds(spark, tmp_path):
    """Keys beyond 32768, equal balances, repeated names, a null nation, and more values than an approximate sketch keeps."""
    rows = pd.DataFrame({"c_custkey": range(100_000)})
    rows["c_name"] = "Customer#" + (rows.c_custkey % 30_000).astype(str)
    rows["c_nationkey"] = pd.array([None if k >= 90_000 else k % 2 for k in rows.c_custkey], "Int32")
    rows["c_acctbal"] = (rows.c_custkey * 7919 % 99_991 // 3).astype(float)
    rows["c_mktsegment"] = "S" + (rows.c_custkey % 3).astype(str)
    rows.to_parquet(tmp_path / "customer.parquet", index=False)
    con = duckdb.connect(config={"threads": 1})  # with more, DuckDB takes any of equal balances
    con.sql(f"CREATE VIEW customer AS FROM '{tmp_path}/customer.parquet'")
    richest = con.sql(registry.ORACLE_SQL["fn_aggregates"]).select("c_nationkey", "richest").fetchall()
    assert {tuple(r) for r in registry.QUERIES["fn_aggregates"](spark, str(tmp_path)).select("c_nationkey", "richest").collect()} == set(richest)
    want = con.sql(registry.ORACLE_SQL["fn_collecting_aggregates"])
    got = registry.QUERIES["fn_collecting_aggregates"](spark, str(tmp_path))
    order = lambda found: sorted(found, key=str)
    assert got.columns == want.columns
    assert order(map(tuple, got.collect())) == order(want.fetchall())
