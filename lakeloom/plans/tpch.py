"""Star-schema queries: the headline workload."""

from __future__ import annotations

from lakeloom import functions as L
from lakeloom.functions import col, lit
from lakeloom.plans.registry import query


def day(text: str):
    return lit(text).cast("timestamp_ntz")


REVENUE = "sum(l_extendedprice * (1 - l_discount))"


def net():
    return col("l_extendedprice") * (1 - col("l_discount"))


@query(
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base_price, sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price, "
    "sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge, avg(l_quantity) AS avg_qty, avg(l_extendedprice) AS avg_price, avg(l_discount) AS avg_disc, count(*) AS count_order "
    "FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"
)
def tpch_q1(t):
    return (
        t.lineitem.filter(col("l_shipdate") <= day("1998-09-02"))
        .group_by("l_returnflag", "l_linestatus")
        .agg(
            L.sum("l_quantity").alias("sum_qty"), L.sum("l_extendedprice").alias("sum_base_price"), L.sum(net()).alias("sum_disc_price"), L.sum(net() * (1 + col("l_tax"))).alias("sum_charge"),
            L.avg("l_quantity").alias("avg_qty"), L.avg("l_extendedprice").alias("avg_price"), L.avg("l_discount").alias("avg_disc"), L.count("*").alias("count_order"),
        )
    )


@query(
    f"SELECT l_orderkey, o_orderdate, {REVENUE} AS revenue FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey "
    "AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY ALL ORDER BY revenue DESC, l_orderkey LIMIT 10"
)
def tpch_q3(t):
    c = t.customer.filter(col("c_mktsegment") == "BUILDING").select("c_custkey")
    o = t.orders.filter(col("o_orderdate") < day("1995-03-15")).select("o_orderkey", "o_custkey", "o_orderdate")
    li = t.lineitem.filter(col("l_shipdate") > day("1995-03-15")).select("l_orderkey", "l_extendedprice", "l_discount")
    joined = o.join(c, col("o_custkey") == col("c_custkey")).join(li, col("l_orderkey") == col("o_orderkey"))
    return joined.group_by("l_orderkey", "o_orderdate").agg(L.sum(net()).alias("revenue")).sort(col("revenue").desc(), "l_orderkey").limit(10)


@query(
    "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1993-07-01' AND o_orderdate < TIMESTAMP '1993-10-01' "
    "AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) GROUP BY ALL"
)
def tpch_q4(t):
    o = t.orders.filter((col("o_orderdate") >= day("1993-07-01")) & (col("o_orderdate") < day("1993-10-01")))
    li = t.lineitem.filter(col("l_quantity") > 30).select("l_orderkey")
    return o.join(li, col("o_orderkey") == col("l_orderkey"), "semi").group_by("o_orderpriority").agg(L.count("*").alias("order_count"))


@query(
    f"SELECT n_name, {REVENUE} AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey "
    "AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY ALL"
)
def tpch_q5(t):
    places = t.nation.join(t.region.filter(col("r_name") == "ASIA"), col("n_regionkey") == col("r_regionkey")).select("n_nationkey", "n_name")
    s = t.supplier.select("s_suppkey", "s_nationkey").join(places, col("s_nationkey") == col("n_nationkey"))
    c = t.customer.select("c_custkey", "c_nationkey")
    li = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    joined = t.orders.select("o_orderkey", "o_custkey").join(c, col("o_custkey") == col("c_custkey")).join(li, col("l_orderkey") == col("o_orderkey"))
    joined = joined.join(s, (col("l_suppkey") == col("s_suppkey")) & (col("c_nationkey") == col("s_nationkey")))
    return joined.group_by("n_name").agg(L.sum(net()).alias("revenue"))


@query("SELECT sum(l_extendedprice * l_discount) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def tpch_q6(t):
    kept = t.lineitem.filter((col("l_shipdate") >= day("1994-01-01")) & (col("l_shipdate") < day("1995-01-01")) & col("l_discount").between(0.05, 0.07) & (col("l_quantity") < 24))
    return kept.agg(L.sum(col("l_extendedprice") * col("l_discount")).alias("revenue"))


@query(
    f"SELECT c_custkey, c_name, {REVENUE} AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey "
    "GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20"
)
def tpch_q10(t):
    li = t.lineitem.filter(col("l_returnflag") == "R").select("l_orderkey", "l_extendedprice", "l_discount")
    joined = t.orders.select("o_orderkey", "o_custkey").join(li, col("l_orderkey") == col("o_orderkey")).join(t.customer, col("o_custkey") == col("c_custkey")).join(t.nation, col("c_nationkey") == col("n_nationkey"))
    return joined.group_by("c_custkey", "c_name", "c_acctbal", "n_name").agg(L.sum(net()).alias("revenue")).sort(col("revenue").desc(), "c_custkey").limit(20)


@query("SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY ALL) GROUP BY ALL")
def tpch_q13(t):
    o = t.orders.filter(col("o_orderpriority") != "1-URGENT").select("o_orderkey", "o_custkey")
    counts = t.customer.select("c_custkey").join(o, col("c_custkey") == col("o_custkey"), "left").group_by("c_custkey").agg(L.count("o_orderkey").alias("c_count"))
    return counts.group_by("c_count").agg(L.count("*").alias("custdist"))


@query(
    "SELECT 100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)) AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey "
    "AND l_shipdate >= TIMESTAMP '1995-09-01' AND l_shipdate < TIMESTAMP '1995-12-01'"
)
def tpch_q14(t):
    li = t.lineitem.filter((col("l_shipdate") >= day("1995-09-01")) & (col("l_shipdate") < day("1995-12-01"))).select("l_partkey", "l_extendedprice", "l_discount")
    joined = li.join(t.part.select("p_partkey", "p_type"), col("l_partkey") == col("p_partkey"))
    return joined.agg((100.0 * L.sum(L.when(col("p_type").like("PROMO%"), net()).otherwise(0)) / L.sum(net())).alias("promo_revenue"))


@query(
    "SELECT c_name, c_custkey, o_orderkey, o_totalprice, sum(l_quantity) AS sum_qty FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) "
    "AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY ALL"
)
def tpch_q18(t):
    sums = t.lineitem.group_by("l_orderkey").agg(L.sum("l_quantity").alias("sum_qty")).filter(col("sum_qty") > 200)
    joined = sums.join(t.orders, col("l_orderkey") == col("o_orderkey")).join(t.customer, col("o_custkey") == col("c_custkey"))
    return joined.select("c_name", "c_custkey", "o_orderkey", "o_totalprice", "sum_qty")
