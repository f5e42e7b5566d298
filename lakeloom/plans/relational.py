"""Relational, reshaping, join, window and table operators."""

from __future__ import annotations

from lakeloom import functions as L
from lakeloom.frame import Frame
from lakeloom.functions import col, lit
from lakeloom.operators import dml
from lakeloom.operators.grouping import GroupingSets
from lakeloom.plans.registry import query
from lakeloom.streaming.windows import sessions, windowed_counts
from lakeloom.window import Interval, Window


@query("SELECT o_orderkey, o_totalprice * 2 AS twice, upper(o_orderpriority) AS prio FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O')")
def project_filter(t):
    return t.orders.filter((col("o_totalprice") > 100000) & col("o_orderstatus").in_("F", "O")).select("o_orderkey", (col("o_totalprice") * 2).as_("twice"), L.upper("o_orderpriority").as_("prio"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal, c_acctbal / 2 AS half FROM customer")
def with_columns_rename(t):
    return t.customer.with_column("half", col("c_acctbal") / 2).rename({"c_custkey": "id", "c_name": "name"}).drop("c_nationkey", "c_mktsegment")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15 OFFSET 5")
def sort_limit_offset(t):
    return t.part.sort(col("p_retailprice").desc(), "p_partkey").limit(15, offset=5).select("p_partkey", "p_name")


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(t):
    return t.customer.select("c_nationkey", "c_mktsegment").distinct()


@query("SELECT c_nationkey, min(c_custkey) AS first_key FROM customer GROUP BY ALL")
def drop_duplicates_by_key(t):
    w = Window.partition_by("c_nationkey").order_by("c_custkey")
    return t.customer.with_column("rn", L.row_number().over(w)).filter(col("rn") == 1).select("c_nationkey", col("c_custkey").as_("first_key"))


@query("SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region")
def union_distinct(t):
    return t.nation.select(col("n_nationkey").as_("k")).union(t.region.select(col("r_regionkey").as_("k")))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def union_all_by_name(t):
    return t.nation.select(col("n_nationkey").as_("k"), col("n_name").as_("name")).union_all_by_name(t.region.select(col("r_name").as_("name"), col("r_regionkey").as_("k")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_rows(t):
    return t.customer.select(col("c_nationkey").as_("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def except_rows(t):
    return t.nation.select(col("n_nationkey").as_("k")).except_(t.supplier.select("s_nationkey"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, sum(c_acctbal) AS bal FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def rollup_groups(t):
    return t.customer.rollup("c_mktsegment", "c_nationkey").agg(L.count("*").alias("n"), L.sum("c_acctbal").alias("bal"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_groups(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(L.count("*").alias("n"), L.grouping("l_returnflag").alias("g"))


@query("SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(t):
    return t.orders.group_by_grouping_sets(GroupingSets(["o_orderstatus"], ["o_orderpriority"], [])).agg(L.sum("o_totalprice").alias("total"))


@query(
    "SELECT c_mktsegment, sum(CASE WHEN c_nationkey = 0 THEN c_acctbal END) AS \"0\", sum(CASE WHEN c_nationkey = 1 THEN c_acctbal END) AS \"1\", sum(CASE WHEN c_nationkey = 2 THEN c_acctbal END) AS \"2\" FROM customer GROUP BY ALL"
)
def pivot_sum(t):
    return t.customer.select("c_mktsegment", "c_nationkey", "c_acctbal").pivot("c_nationkey", [0, 1, 2]).sum("c_acctbal")


@query("SELECT l_orderkey, l_linenumber, 'l_discount' AS measure, l_discount AS value FROM lineitem WHERE l_discount IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem WHERE l_tax IS NOT NULL")
def unpivot_columns(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_tax").unpivot("value", "measure", ["l_discount", "l_tax"])


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(t):
    return t.nation.join(t.region, col("n_regionkey") == col("r_regionkey")).select("n_name", "r_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
def join_left_theta(t):
    return t.customer.join(t.orders, (col("c_custkey") == col("o_custkey")) & (col("o_totalprice") > 200000), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(t):
    return t.supplier.join(t.nation, col("s_nationkey") == col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN (SELECT * FROM customer WHERE c_acctbal < 0) c ON s_suppkey = c_custkey")
def join_full(t):
    return t.supplier.join(t.customer.filter(col("c_acctbal") < 0), col("s_suppkey") == col("c_custkey"), "full").select("s_suppkey", "c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(t):
    return t.customer.join(t.orders, col("c_custkey") == col("o_custkey"), "anti").select("c_custkey")


@query("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) JOIN (SELECT r_regionkey AS k, r_name FROM region) USING (k)")
def join_using(t):
    return t.nation.select(col("n_regionkey").as_("k"), "n_name").join(t.region.select(col("r_regionkey").as_("k"), "r_name"), "k")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return t.region.cross_join(t.nation).select("r_name", "n_name")


@query(
    "SELECT o_orderkey, o_custkey, o_orderdate, e_id, e_value FROM (SELECT o_orderkey, o_custkey, o_orderdate FROM orders) o ASOF LEFT JOIN "
    "(SELECT user_id, ts, max(event_id) AS e_id, max(value) FILTER (WHERE true) AS e_value FROM events GROUP BY user_id, ts) e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts"
)
def join_asof(t):
    e = t.events.group_by("user_id", "ts").agg(L.max("event_id").alias("e_id"), L.max("value").alias("e_value"))
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return o.join(e, [(col("o_custkey"), col("user_id"))], "asof", match_condition=(col("o_orderdate"), ">=", col("ts"))).select("o_orderkey", "o_custkey", "o_orderdate", "e_id", "e_value")


@query("SELECT event_id, (SELECT max(b.event_id) FROM (SELECT * FROM events WHERE event_type = 'purchase') b WHERE b.ts = (SELECT max(c.ts) FROM events c WHERE c.event_type = 'purchase' AND c.ts <= a.ts)) AS buy FROM events a WHERE event_type = 'click'")
def join_asof_without_keys(t):
    buys = t.events.filter(col("event_type") == "purchase").group_by("ts").agg(L.max("event_id").alias("buy")).rename("ts", "bought")
    return t.events.filter(col("event_type") == "click").select("event_id", "ts").join(buys, None, "asof", match_condition=("ts", ">=", "bought")).select("event_id", "buy")


@query(
    "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, "
    "ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nt FROM orders"
)
def window_ranks(t):
    w = Window.partition_by("o_custkey")
    by_date, by_priority = w.order_by("o_orderdate", "o_orderkey"), w.order_by("o_orderpriority")
    return t.orders.select("o_orderkey", "o_custkey", L.row_number().over(by_date).as_("rn"), L.rank().over(by_priority).as_("rk"), L.dense_rank().over(by_priority).as_("dr"), L.ntile(4).over(by_date).as_("nt"))


@query(
    "SELECT o_orderkey, lag(o_totalprice, 1) OVER w AS prev, lead(o_totalprice, 2, 0.0) OVER w AS nxt, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, "
    "sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
)
def window_values(t):
    w = Window.partition_by("o_custkey").order_by("o_orderdate", "o_orderkey")
    return t.orders.select(
        "o_orderkey", L.lag("o_totalprice", 1).over(w).as_("prev"), L.lead("o_totalprice", 2, 0.0).over(w).as_("nxt"), L.first_value("o_orderkey").over(w).as_("first"), L.last_value("o_orderkey").over(w).as_("last"),
        L.sum("o_totalprice").over(w.rows_between(-2, Window.CURRENT_ROW)).as_("moving"),
    )


@query("SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_sum FROM events")
def window_range_interval(t):
    w = Window.partition_by("user_id").order_by("ts").range_between(-Interval(1, "day"), Window.CURRENT_ROW)
    return t.events.select("event_id", L.sum("value").over(w).as_("day_sum"))


@query(
    "SELECT event_id, sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value_sum_3, avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value_avg_3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
)
def analytics_moving(t):
    return t.events.analytics.moving_agg({"value": ["sum", "avg"]}, [3], ["ts", "event_id"], ["user_id"]).select("event_id", "value_sum_3", "value_avg_3")


@query("SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value_sum FROM events")
def analytics_cumulative(t):
    return t.events.analytics.cumulative_agg({"value": ["sum"]}, ["user_id"], ["ts", "event_id"], True).select("event_id", "value_sum")


@query("SELECT event_id, lag(value, 1) OVER w AS value_LAG_1, lead(value, 2) OVER w AS value_LEAD_2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def analytics_lag_lead(t):
    keys = {"order_by": ["ts", "event_id"], "group_by": ["user_id"]}
    return t.events.analytics.compute_lag(["value"], [1], **keys).analytics.compute_lead(["value"], [2], **keys).select("event_id", "value_LAG_1", "value_LEAD_2")


@query(
    'SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 7 DAY FOLLOWING) AS "value_sum_7D", max(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW) AS "value_max_-2H" FROM events'
)
def analytics_time_series(t):
    return Frame(t.events.analytics.time_series_agg("ts", {"value": ["sum"]}, ["7D"], ["user_id"]).analytics.time_series_agg("ts", {"value": ["max"]}, ["-2H"], ["user_id"])).select("event_id", "value_sum_7D", "value_max_-2H")


@query("SELECT event_id, coalesce(value, 0) AS value, coalesce(event_type, 'none') AS event_type FROM events")
def na_fill(t):
    return t.events.select("event_id", "value", "event_type").na.fill({"value": 0.0, "event_type": "none"})


@query("SELECT event_id FROM events WHERE value IS NOT NULL AND props IS NOT NULL")
def na_drop(t):
    return t.events.na.drop("any", subset=["value", "props"]).select("event_id")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def na_replace(t):
    return t.orders.select("o_orderkey", "o_orderstatus").na.replace({"F": "finished", "O": "open"})


@query("SELECT corr(l_quantity, l_extendedprice) AS r, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem")
def stat_corr_cov(t):
    return t.lineitem.agg(L.corr("l_quantity", "l_extendedprice").alias("r"), L.covar_samp("l_quantity", "l_extendedprice").alias("c"))


@query("SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS \"1-URGENT\", count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS \"2-HIGH\" FROM orders GROUP BY ALL")
def stat_crosstab(t):
    return t.orders.stat.crosstab("o_orderstatus", "o_orderpriority").select("o_orderstatus", "1-URGENT", "2-HIGH")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def dml_update(t):
    rows, _ = dml.update(t.customer._spark_object.select("c_custkey", "c_acctbal", "c_mktsegment"), {"c_acctbal": 0.0}, (col("c_mktsegment") == "BUILDING") & (col("c_acctbal") < 0))
    return rows.select("c_custkey", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def dml_delete_using(t):
    c, o = t.customer._spark_object.select("c_custkey"), t.orders.filter(col("o_totalprice") > 150000)._spark_object.select("o_custkey")
    return dml.delete(c, c.c_custkey == o.o_custkey, o)


@query(
    "WITH s AS (SELECT c_custkey + 5 AS k, c_acctbal AS b FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(c.c_custkey, s.k) AS id, CASE WHEN c.c_custkey IS NULL THEN s.b WHEN s.k IS NOT NULL AND s.b > 0 THEN c.c_acctbal + s.b ELSE c.c_acctbal END AS bal "
    "FROM customer c FULL JOIN s ON c.c_custkey = s.k WHERE NOT (c.c_custkey IS NOT NULL AND s.k IS NOT NULL AND s.b <= 0 AND s.b < -500)"
)
def dml_merge(t):
    target = t.customer._spark_object.selectExpr("c_custkey AS id", "c_acctbal AS bal")
    source = t.customer._spark_object.filter("c_custkey % 2 = 0").selectExpr("c_custkey + 5 AS k", "c_acctbal AS b")
    clauses = [dml.WhenMatched(col("b") > 0).update({"bal": col("bal") + col("b")}), dml.WhenMatched(col("b") < -500).delete(), dml.WhenNotMatched().insert({"id": col("k"), "bal": col("b")})]
    return dml.merge(target, source, target.id == source.k, clauses).filter("__action IS NULL OR __action <> 'D'").drop("__action")


@query("SELECT vec_id, i - 1 AS \"INDEX\", CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def flatten_arrays(t):
    return t.embeddings.select("vec_id", "embedding").flatten("embedding").select("vec_id", "INDEX", col("VALUE").cast("double").as_("x"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS \"VALUE\", generate_subscripts(string_split(p_name, ' '), 1) AS \"INDEX\" FROM part")
def split_to_table(t):
    return t.part.join_table_function("split_to_table", "p_name", " ").select("p_partkey", "VALUE", "INDEX")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL")
def tumbling_windows(t):
    return windowed_counts(t.events, "ts", ["event_type"], "1 hour", n=L.count("*"), v=L.sum("value"))


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) "
    "SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k"
)
def session_windows(t):
    return sessions(t.events, "ts", ["user_id"], "30 minutes")


@query("SELECT n_name, max(c_acctbal) AS top FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL HAVING count(*) > 3")
def having(t):
    return t.nation.join(t.customer, col("c_nationkey") == col("n_nationkey")).group_by("n_name").agg(L.max("c_acctbal").alias("top"), L.count("*").alias("n")).filter(col("n") > 3).drop("n")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def in_subquery(t):
    return t.customer.filter(col("c_nationkey").in_(t.nation.filter(col("n_regionkey") == 1).select("n_nationkey"))).select("c_custkey")


@query("SELECT range AS \"ID\", range * range AS sq FROM range(1000)")
def range_rows(t):
    return Frame(t.spark.range(0, 1000).toDF("ID")).with_column("sq", col("ID") * col("ID"))


@query("SELECT n_nationkey, n_name FROM nation WHERE regexp_full_match(n_name, '.*A.*')")
def filter_regexp_whole(t):
    return t.nation.filter(col("n_name").regexp(".*A.*")).select("n_nationkey", "n_name")


@query("SELECT lit.o_orderpriority, count(*) AS n FROM orders lit GROUP BY ALL ORDER BY n DESC, lit.o_orderpriority LIMIT 3")
def top_groups(t):
    return t.orders.group_by("o_orderpriority").count().rename("COUNT", "n").sort(col("n").desc(), "o_orderpriority").limit(3)


_ = lit
