"""More operators over whole tables: laterals, distributions, set operations with missing columns, conversions."""

from __future__ import annotations

from lakeloom import functions as L
from lakeloom.frame import Frame
from lakeloom.functions import col, lit
from lakeloom.plans.registry import query
from lakeloom.window import Window


@query("SELECT l_orderkey, l_linenumber, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice)")
def window_distribution(t):
    return t.lineitem.analytics.distribution("l_returnflag", "l_extendedprice", "pr", "cd").select("l_orderkey", "l_linenumber", "pr", "cd")


@query("SELECT o_orderkey, nth_value(o_orderkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_nth_value(t):
    w = Window.partition_by("o_custkey").order_by("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", L.nth_value("o_orderkey", 2).over(w).as_("second"), L.count("*").over(Window.partition_by("o_custkey")).as_("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_semi(t):
    return t.customer.join(t.orders.filter(col("o_orderstatus") == "F"), col("c_custkey") == col("o_custkey"), "semi").select("c_custkey")


@query("SELECT n_nationkey AS k, n_name, c FROM (SELECT n_nationkey, n_name FROM nation) JOIN (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY ALL) ON n_nationkey = s_nationkey")
def join_natural(t):
    n = t.nation.select(col("n_nationkey").as_("k"), "n_name")
    return n.natural_join(t.supplier.group_by(col("s_nationkey").as_("k")).agg(L.count("*").alias("c")))


@query("SELECT n_nationkey AS k, n_name, NULL AS r_name FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def union_missing_columns(t):
    return t.nation.select(col("n_nationkey").as_("k"), "n_name").union_all_by_name(t.region.select(col("r_regionkey").as_("k"), "r_name"), allow_missing_columns=True)


@query("SELECT count(*) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer")
def describe_column(t):
    stats = t.customer.describe("c_acctbal")
    pick = lambda name: L.max(L.when(col("SUMMARY") == name, col("c_acctbal")).otherwise(lit(None)))
    return stats.agg(pick("count").cast("bigint").alias("n"), pick("mean").alias("mean"), pick("stddev").alias("sd"), pick("min").alias("lo"), pick("max").alias("hi"))


@query("SELECT p_partkey, p_brand || '/' || p_size AS tag, CAST(p_size AS VARCHAR) AS txt, TRY_CAST(substr(p_brand, 7) AS INTEGER) AS num, p_size > 25 AS big FROM part")
def casts(t):
    return t.part.select("p_partkey", L.concat(col("p_brand"), lit("/"), col("p_size").cast("string")).as_("tag"), L.to_char("p_size").as_("txt"), L.try_cast(L.substring("p_brand", 7), "int").as_("num"), (col("p_size") > 25).as_("big"))


@query("SELECT event_type, min(event_id) AS lo, max(event_id) AS hi, approx_count_distinct(event_type) AS kinds, mode(event_type) AS m FROM events GROUP BY ALL")
def agg_mode_any(t):
    return t.events.group_by("event_type").agg(L.min("event_id").alias("lo"), L.max("event_id").alias("hi"), L.approx_count_distinct("event_type").alias("kinds"), L.mode("event_type").alias("m"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS kinds, list_sort(list(DISTINCT o_orderstatus))[1] AS first_status FROM orders GROUP BY ALL")
def agg_distinct_lists(t):
    return t.orders.group_by("o_custkey").agg(L.listagg("o_orderpriority", "|", True).alias("kinds"), L.get(L.array_sort(L.collect_set("o_orderstatus")), 0).alias("first_status"))


@query("SELECT role, count(*) AS n, sum(length(text)) AS chars FROM conversations WHERE turn BETWEEN 1 AND 5 GROUP BY ALL")
def group_between(t):
    return t.conversations.filter(col("turn").between(1, 5)).group_by("role").agg(L.count("*").alias("n"), L.sum(L.length("text")).alias("chars"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def scalar_subquery(t):
    mean = t.customer._spark_object.agg({"c_acctbal": "avg"}).scalar()
    return t.customer.filter(col("c_acctbal") > mean).select("c_custkey", "c_acctbal")


@query("SELECT n_nationkey, c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2)")
def lateral_top(t):
    c = t.customer._spark_object
    inner = c.where(c.c_nationkey == col("n_nationkey").c.outer()).orderBy(c.c_acctbal.desc(), c.c_custkey).limit(2).select("c_custkey")
    return t.nation.lateral_join(Frame(inner)).select("n_nationkey", "c_custkey")


@query("SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS slice, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS hours, extract('hour' FROM ts) AS h, extract('minute' FROM ts) AS mi FROM events")
def time_slices(t):
    return t.events.select("event_id", L.time_slice("ts", 15, "minute").cast("timestamp_ntz").as_("slice"), L.datediff("hour", lit("2024-01-01").cast("timestamp_ntz"), "ts").as_("hours"), L.hour("ts").as_("h"), L.minute("ts").as_("mi"))
