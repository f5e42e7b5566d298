import datetime

import pytest
from pyspark.sql import functions as F

from lakeloom import Frame, GroupingSets, Session, Window, when_matched, when_not_matched
from lakeloom import functions as L
from lakeloom.functions import col, lit
from lakeloom.plans import registry


@pytest.fixture(scope="module")
def session(spark):
    return Session(spark)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def ab(session):
    return session.create_dataframe([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)], ["a", "b"])


@pytest.fixture(scope="module")
def nulls(session):
    return session.create_dataframe([(1, 2, 3), (None, 2, 3), (None, None, 3), (None, None, None), (1, None, 3), (1, None, None), (1, 2, None)], "a int, b int, c int")


def test_projection_and_filters(ab):
    assert rows(ab.filter((col("a") > 1) & (col("b") == 1)).select((col("a") * 2).as_("x"))) == [(4,), (6,)]
    assert ab.with_column("a", col("a") + 1).columns == ["b", "a"]
    assert ab.with_column("a", col("a") + 1, keep_column_order=True).columns == ["a", "b"]
    assert ab.col_ilike("%A%").columns == ["a"]
    assert rows(ab.select("a").union(ab.select("b"))) == [(1,), (2,), (3,)]
    assert len(ab.union_all(ab).collect()) == 12
    with pytest.raises(ValueError):
        ab.drop("a", "b")
    with pytest.raises(ValueError):
        ab.with_column_renamed("nope", "x")
    with pytest.raises(ValueError):
        ab.join(ab, "a")


def test_null_order_and_predicates(nulls):
    assert [r[0] for r in nulls.sort("a").select("a").collect()][:3] == [None] * 3
    assert [r[0] for r in nulls.sort(col("a").desc()).select("a").collect()][-3:] == [None] * 3
    assert nulls.filter(col("a").equal_null(None)).count() == 3
    assert rows(nulls.select(L.greatest("a", "b").as_("g")).distinct()) == [(2,), (None,)]
    assert nulls.na.drop().count() == 1 and nulls.na.drop("all").count() == 6 and nulls.na.drop(thresh=2).count() == 4
    assert rows(nulls.na.fill({"a": 9}).select("a").distinct()) == [(1,), (9,)]


def test_nan_counts_as_missing(session):
    f = session.create_dataframe([(1.0, "a"), (float("nan"), "b"), (None, None)], "x double, s string")
    assert rows(f.na.fill(0.5).select("x")) == [(0.5,), (0.5,), (1.0,)]
    assert rows(f.na.fill(0.5).select("s")) == [("a",), ("b",), (None,)]
    assert f.na.drop().count() == 1
    assert rows(f.na.replace("a", "z").select("s")) == [("b",), ("z",), (None,)]


def test_asof_example(session):
    left = session.create_dataframe([("A", 1, 15, 3.21), ("A", 2, 16, 3.22), ("B", 1, 17, 3.23), ("B", 2, 18, 4.23)], ["c1", "c2", "c3", "c4"])
    right = session.create_dataframe([("A", 1, 14, 3.19), ("B", 2, 16, 3.04)], ["c1", "c2", "c3", "c4"])
    got = rows(left.join(right, ["c1", "c2"], "asof", match_condition=("c3", ">=", "c3")))
    assert [(r[0], r[1], r[6], r[7]) for r in got] == [("A", 1, 14, 3.19), ("A", 2, None, None), ("B", 1, None, None), ("B", 2, 16, 3.04)]
    with pytest.raises(ValueError):
        left.join(right, ["c1"], "asof")
    with pytest.raises(ValueError):
        left.join(right, ["c1"], "inner", match_condition=("c3", ">=", "c3"))


@pytest.mark.parametrize("op", [">=", ">", "<=", "<"])
def test_asof_without_keys_matches_brute_force(session, op):
    left = [(i, (i * 7) % 23) for i in range(20)] + [(99, None)]
    right = [(100 + i, (i * 5) % 21) for i in range(9)]
    lf, rf = session.create_dataframe(left, "l int, t int"), session.create_dataframe(right, "r int, u int")
    fits = {">=": lambda t, u: u <= t, ">": lambda t, u: u < t, "<=": lambda t, u: u >= t, "<": lambda t, u: u > t}[op]
    expected = []
    for i, t in left:
        near = [u for _, u in right if t is not None and fits(t, u)]
        expected.append((i, (max if ">" in op else min)(near) if near else None))
    got = [(r.l, r.u) for r in lf.join(rf, None, "asof", match_condition=("t", op, "u")).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_grouping_forms(ab):
    assert rows(ab.group_by("a").agg(("b", "sum"))) == [(1, 3), (2, 3), (3, 3)]
    assert rows(ab.group_by("a").agg({"b": "max"})) == [(1, 2), (2, 2), (3, 2)]
    assert rows(ab.group_by("a").count()) == [(1, 2), (2, 2), (3, 2)]
    assert len(ab.group_by(GroupingSets(["a"], ["b"])).agg(L.count("*").alias("n")).collect()) == 5
    assert len(ab.cube("a", "b").agg(L.count("*").alias("n")).collect()) == 12
    assert rows(ab.pivot("b", [1, 2]).agg(("a", "sum"))) == [(6, 6)]
    assert ab.group_by("a").pivot("b").sum("b").columns == ["a", "1", "2"]


def test_collected_aggregates(session):
    f = session.create_dataframe([1, 2, 3, 2, 4, 5], ["a"])
    assert f.agg(L.listagg("a", ",").within_group("a").alias("x")).collect()[0][0] == "1,2,2,3,4,5"
    assert f.agg(L.listagg("a", ",", True).alias("x")).collect()[0][0] == "1,2,3,4,5"
    assert f.agg(L.array_agg("a").within_group(col("a").desc()).alias("x")).collect()[0][0] == [5, 4, 3, 2, 2, 1]
    assert session.create_dataframe([1, 1, 2, 2, 3, 3], ["a"]).agg(L.kurtosis("a").alias("k")).collect()[0][0] == pytest.approx(-1.875)
    assert session.create_dataframe([15, 26, 12, 14, 8], ["a"]).agg(L.bitand_agg("a").alias("k")).collect()[0][0] == 8


def test_windows(session):
    f = session.create_dataframe([(101, "2023-01-01", 200), (101, "2023-01-02", 100), (101, "2023-01-03", 300), (102, "2023-01-04", 250)], ["k", "d", "v"]).with_column("d", col("d").cast("timestamp"))
    got = f.analytics.moving_agg({"v": ["sum"]}, [2, 3], ["d"], ["k"]).sort("d").collect()
    assert [(r.v_sum_2, r.v_sum_3) for r in got] == [(200, 200), (300, 300), (400, 600), (250, 250)]
    got = f.analytics.time_series_agg("d", {"v": ["sum"]}, ["1D"], ["k"]).analytics.time_series_agg("d", {"v": ["max"]}, ["-1D"], ["k"]).sort("d").collect()
    assert [(r["v_sum_1D"], r["v_max_-1D"]) for r in got] == [(300, 200), (400, 200), (300, 300), (250, 250)]
    w = Window.partition_by("k").order_by("d")
    assert [r[0] for r in f.select(L.last_value("v").over(w).as_("x"), "d").sort("d").collect()] == [300, 300, 300, 250]


def test_flatten_kinds(session):
    f = session.create_dataframe([(1, [7, 8], {"p": 1}, '{"q": [1, {"r": 2}]}')], "id int, a array<int>, m map<string,int>, j string")
    assert [(r.INDEX, r.VALUE, r.PATH) for r in f.flatten("a").collect()] == [(0, 7, "[0]"), (1, 8, "[1]")]
    assert [(r.KEY, r.VALUE) for r in f.flatten("m").collect()] == [("p", 1)]
    assert [r.PATH for r in f.flatten("j", recursive=True).sort("PATH").collect()] == ["q", "q[0]", "q[1]", "q[1].r"]


def test_table_changes(session, spark):
    session.create_dataframe([(1, "a"), (2, "b"), (3, "c")], "k int, v string").write.save_as_table("changes_t", mode="overwrite")
    t = session.table("changes_t")
    assert t.update({"v": lit("z")}, col("k") == 2).rows_updated == 1
    assert rows(t) == [(1, "a"), (2, "z"), (3, "c")]
    assert t.delete(col("k") == 3).rows_deleted == 1
    source = session.create_dataframe([(1, "new"), (9, "nine")], "sk int, sv string")
    result = t.merge(source, t["k"] == source["sk"], [when_matched().update({"v": col("sv")}), when_not_matched().insert({"k": col("sk"), "v": col("sv")})])
    assert (result.rows_inserted, result.rows_updated, result.rows_deleted) == (1, 1, 0)
    assert rows(session.table("changes_t")) == [(1, "new"), (2, "z"), (9, "nine")]
    t.drop_table()
    assert not session.catalog.table_exists("changes_t")


def test_sources_round_trip(session, tmp_path):
    f = session.create_dataframe([(1, "x"), (2, None)], "a int, b string")
    for kind in ("csv", "json", "parquet", "orc"):
        path = str(tmp_path / kind)
        getattr(f.write.mode("overwrite").option("header", True), kind)(path)
        reader = session.read.schema("a int, b string").option("parse_header", True)
        assert rows(getattr(reader, kind)(path)) == [(1, "x"), (2, None)]
    assert session.read.directory(str(tmp_path / "csv")).count() >= 1
    assert session.read.with_metadata("file_path").parquet(str(tmp_path / "parquet")).columns == ["file_path", "a", "b"]


def test_dbapi_reads_in_parts(session, tmp_path):
    import sqlite3

    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("create table t (id integer, name text, v real)")
        c.executemany("insert into t values (?, ?, ?)", [(i if i else None, f"n{i}", i / 2) for i in range(50)])
    got = session.read.dbapi(lambda: __import__("sqlite3").connect(path), table="t", column="id", lower_bound=0, upper_bound=50, num_partitions=4)
    assert got.count() == 50 and got.agg(L.sum("id").alias("s")).collect()[0][0] == sum(range(50))


def test_functions_written_by_users(session):
    add = session.udf.register(lambda a, b: a + b, "int", name="add_them")
    f = session.create_dataframe([(1, 2), (3, 4)], "a int, b int")
    assert rows(f.select(add("a", "b").as_("s"))) == [(3,), (7,)]
    assert session.sql("SELECT add_them(1, 5)").collect()[0][0] == 6

    class Total:
        def __init__(self):
            self.n = 0

        @property
        def aggregate_state(self):
            return self.n

        def accumulate(self, x):
            self.n += x

        def merge(self, other):
            self.n += other

        def finish(self):
            return self.n

    assert rows(session.udaf.aggregate(f, Total, ["a"], ["b"], "bigint")) == [(1, 2), (3, 4)]

    class Spell:
        def process(self, n):
            for i in range(n):
                yield (i,)

    spell = session.udtf.register(Spell, "i int")
    assert len(f.join_table_function(spell(col("a"))).collect()) == 4
    session.sproc.register(lambda s, n: s.range(n).count(), name="counted")
    assert session.call("counted", 7) == 7
    job = f.collect_nowait()
    assert len(job.result()) == 2 and job.is_done() and job.status() == "SUCCESS"


def test_stream_of_windows(session, spark, tmp_path):
    from lakeloom.streaming.windows import windowed_counts

    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(at, 1), (at + datetime.timedelta(minutes=20), 2), (at + datetime.timedelta(hours=5), 3)], "ts timestamp, v int").write.parquet(str(tmp_path / "in"))
    stream = Frame(spark.readStream.schema("ts timestamp, v int").parquet(str(tmp_path / "in")))
    q = windowed_counts(stream, "ts", [], "1 hour", late="10 minutes").writeStream.format("memory").queryName("stream_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r)[2] for r in spark.sql("SELECT * FROM stream_out").collect()] == [2]


def test_changes_from_a_source_are_equi_joins(spark):
    from lakeloom.operators import dml

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        target = spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "k int, v int")
        source = spark.createDataFrame([(1, 5), (1, 5), (3, 7)], "k2 int, w int")
        met = target.k == source.k2
        updated = dml.update(target, {"v": source.w}, met, source)[0]
        deleted = dml.delete(target, met, source)
        merged = dml.merge(target, source.distinct(), target.k == source.k2, [dml.WhenMatched().update({"v": source.w}), dml.WhenNotMatched().insert({"k": source.k2, "v": source.w})])
        for frame in (updated, deleted, merged):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "CartesianProduct" not in plan
        key = lambda r: str(r)
        assert sorted(map(tuple, updated.collect()), key=key) == sorted([(1, 5, True), (2, 20, False), (None, 30, False)], key=key)
        assert sorted(map(tuple, deleted.collect()), key=key) == sorted([(2, 20), (None, 30)], key=key)
        assert sorted(map(tuple, merged.collect()), key=key) == sorted([(1, 5, "U"), (2, 20, None), (None, 30, None), (3, 7, "I")], key=key)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_changed_tables_keep_their_partitions(spark):
    from lakeloom.table import Table

    spark.sql("CREATE TABLE parted (v INT, p STRING) USING parquet PARTITIONED BY (p) TBLPROPERTIES ('note' = 'kept')")
    spark.sql("INSERT INTO parted VALUES (1, 'a'), (2, 'b'), (3, 'b')")
    table = Table(spark, "parted")
    assert table.update({"v": table["v"] + 10}, table["p"] == "b").rows_updated == 2
    assert table.delete(table["v"] == 1).rows_deleted == 1
    assert sorted(map(tuple, spark.table("parted").collect())) == [(12, "b"), (13, "b")]
    told = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED parted").collect()}
    assert "# Partition Information" in told and "note=kept" in told["Table Properties"]
    spark.sql("DROP TABLE parted")


def test_distribution_matches_the_window(spark):
    """Null and repeated keys and places, groups of one row, a place that most rows share, odd doubles, and no keys at all."""
    doubles = [None, float("nan"), -0.0, 0.0, float("-inf"), 1.5, -1.5]
    rows = [(i, [None, "a", "b"][i % 3], doubles[i * i % 7] if i % 2 else float(i % 50), i % 11) for i in range(600)] + [(i, "hot", 7.0, 1) for i in range(600, 900)] + [(900, "one", 3.0, None)]
    frame = Session(spark).create_dataframe(rows, "id int, g string, x double, y int")
    for keys, orders in ((["g"], [col("x")]), (["g"], [col("x").desc_nulls_last(), col("y").asc_nulls_last()]), ([], [col("y").desc()]), ([col("y") % 3, "g"], ["x"])):
        window = Window.partition_by(*keys).order_by(*orders)
        want = frame.select("id", L.percent_rank().over(window).as_("pr"), L.cume_dist().over(window).as_("cd"))
        got = frame.analytics.distribution(keys, orders, "pr", "cd")
        assert got.columns == ["id", "g", "x", "y", "pr", "cd"]
        assert sorted(map(tuple, got.select("id", "pr", "cd").collect())) == sorted(map(tuple, want.collect()))
    assert frame.limit(0).analytics.distribution("g", "x").count() == 0


def test_distribution_of_one_large_group_is_dealt_out(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "'N' AS l_returnflag", "CAST(id * 7919 % 10007 AS DOUBLE) AS l_extendedprice")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1")):
            spark.conf.set(k, v)
        sizes = [r[1] for r in registry.QUERIES["window_distribution"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*"), F.sum("pr"), F.sum("cd")).collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20_000 and max(sizes) < 10_000
