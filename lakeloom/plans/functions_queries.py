"""The function library over whole tables."""

from __future__ import annotations

from lakeloom import functions as L
from lakeloom.functions import col, lit
from lakeloom.plans.registry import query


@query(
    "SELECT c_nationkey, count(*) AS n, count(DISTINCT c_mktsegment) AS kinds, sum(c_acctbal) AS s, avg(c_acctbal) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi, median(c_acctbal) AS med, stddev_samp(c_acctbal) AS sd, stddev_pop(c_acctbal) AS sdp, var_samp(c_acctbal) AS v, var_pop(c_acctbal) AS vp, "
    "arg_max(c_custkey, c_acctbal) AS richest FROM customer GROUP BY ALL"
)
def fn_aggregates(t):
    x = "c_acctbal"
    first = L.when(col(x).is_not_null() & col("c_custkey").is_not_null(), L.struct(col(x), -col("c_custkey")))  # of equal balances, the smallest key
    return t.customer.group_by("c_nationkey").agg(
        L.count("*").alias("n"), L.count_distinct("c_mktsegment").alias("kinds"), L.sum(x).alias("s"), L.avg(x).alias("a"), L.min(x).alias("lo"), L.max(x).alias("hi"), L.median(x).alias("med"), L.stddev(x).alias("sd"), L.stddev_pop(x).alias("sdp"),
        L.variance(x).alias("v"), L.var_pop(x).alias("vp"), L.max_by("c_custkey", first).alias("richest"),
    )


@query("SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY c_custkey DESC) AS names, quantile_cont(c_acctbal, 0.25) AS q, kurtosis(c_acctbal) AS k, skewness(c_acctbal) AS sk FROM customer GROUP BY ALL HAVING count(*) > 4")
def fn_ordered_aggregates(t):
    out = t.customer.group_by("c_nationkey").agg(
        L.listagg("c_mktsegment", ",").within_group(col("c_custkey").desc()).alias("names"), L.percentile_cont(0.25).within_group("c_acctbal").alias("q"), L.kurtosis("c_acctbal").alias("k"), L.skew("c_acctbal").alias("sk"), L.count("*").alias("n")
    )
    return out.filter(col("n") > 4).drop("n")


@query("SELECT l_linestatus, bit_and(l_partkey) AS a, bit_or(l_partkey) AS o, bit_xor(l_partkey) AS x, bool_and(l_tax > 0) AS ba, bool_or(l_tax > 0.07) AS bo, regr_slope(l_extendedprice, l_quantity) AS slope, regr_r2(l_extendedprice, l_quantity) AS r2, regr_count(l_extendedprice, l_quantity) AS rc FROM lineitem GROUP BY ALL")
def fn_bit_bool_regr(t):
    y, x = "l_extendedprice", "l_quantity"
    return t.lineitem.group_by("l_linestatus").agg(
        L.bitand_agg("l_partkey").alias("a"), L.bitor_agg("l_partkey").alias("o"), L.bitxor_agg("l_partkey").alias("x"), L.booland_agg(col("l_tax") > 0).alias("ba"), L.boolor_agg(col("l_tax") > 0.07).alias("bo"), L.regr_slope(y, x).alias("slope"), L.regr_r2(y, x).alias("r2"),
        L.regr_count(y, x).alias("rc"),
    )


@query(
    "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS nf, coalesce(nullif(o_orderstatus, 'P'), 'none') AS nv, greatest(o_orderkey, o_custkey) AS g, least(o_orderkey, o_custkey) AS l, "
    "CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_totalprice / (o_custkey % 3) END AS d FROM orders"
)
def fn_conditional(t):
    return t.orders.select(
        "o_orderkey", L.when(col("o_totalprice") > 150000, "big").when(col("o_totalprice") > 50000, "mid").otherwise("small").as_("size"), L.nullif("o_orderstatus", lit("F")).as_("nf"), L.coalesce(L.nullif("o_orderstatus", lit("P")), lit("none")).as_("nv"),
        L.greatest("o_orderkey", "o_custkey").as_("g"), L.least("o_orderkey", "o_custkey").as_("l"), L.div0("o_totalprice", col("o_custkey") % 3).as_("d"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, sqrt(l_quantity) AS s, ln(l_extendedprice) AS n, log10(l_extendedprice) AS l10, power(l_quantity, 2) AS p, round(l_extendedprice, -2) AS r, floor(l_extendedprice / 7) AS f, ceil(l_extendedprice / 7) AS c, sin(l_quantity) AS si, atan2(l_tax, l_discount + 1) AS at, "
    "l_partkey % 7 AS m, l_partkey & 12 AS ba, l_partkey | 3 AS bo, xor(l_partkey, 5) AS bx, sign(l_discount - 0.05) AS sg, trunc(l_extendedprice / 100) AS t FROM lineitem"
)
def fn_numeric(t):
    e, q = col("l_extendedprice"), col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", L.abs(col("l_discount") - 0.05).as_("a"), L.sqrt(q).as_("s"), L.ln(e).as_("n"), L.log(10, e).as_("l10"), (q**2).as_("p"), L.round(e, -2).as_("r"), L.floor(e / 7).as_("f"), L.ceil(e / 7).as_("c"), L.sin(q).as_("si"),
        L.atan2(col("l_tax"), col("l_discount") + 1).as_("at"), L.mod("l_partkey", lit(7)).as_("m"), L.bitand("l_partkey", lit(12)).as_("ba"), L.bitor("l_partkey", lit(3)).as_("bo"), L.bitxor("l_partkey", lit(5)).as_("bx"), L.sign(col("l_discount") - 0.05).as_("sg"), L.truncate(e / 100).as_("t"),
    )


@query(
    "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n, substring(p_name, 2, 4) AS s, left(p_name, 3) AS lf, right(p_name, 3) AS rt, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp, replace(p_name, 'a', '_') AS re, reverse(p_name) AS rv, translate(p_name, 'aeiou', '12345') AS tr, "
    "p_brand || '-' || p_type AS cw, instr(p_name, 'a') AS ci, split_part(p_type, ' ', 2) AS sp, repeat(p_brand, 2) AS rp2, md5(p_name) AS m5, ascii(p_name) AS asc_, levenshtein(p_brand, p_type) AS ed, contains(p_name, 'e') AS co, starts_with(p_name, 'a') AS st FROM part"
)
def fn_strings(t):
    n = "p_name"
    return t.part.select(
        "p_partkey", L.upper(n).as_("u"), L.lower("p_brand").as_("l"), L.length(n).as_("n"), L.substring(n, 2, 4).as_("s"), L.left(n, 3).as_("lf"), L.right(n, 3).as_("rt"), L.lpad("p_brand", 12, "*").as_("lp"), L.rpad("p_brand", 12, "*").as_("rp"), L.replace(n, lit("a"), lit("_")).as_("re"), L.reverse(n).as_("rv"),
        L.translate(n, "aeiou", "12345").as_("tr"), L.concat_ws("-", "p_brand", "p_type").as_("cw"), L.charindex("a", n).as_("ci"), L.split_part("p_type", " ", 2).as_("sp"), L.repeat("p_brand", 2).as_("rp2"), L.md5(n).as_("m5"), L.ascii(n).as_("asc_"), L.editdistance("p_brand", "p_type").as_("ed"), L.contains(n, "e").as_("co"),
        L.startswith(n, "a").as_("st"),
    )


@query(
    "SELECT doc_id, len(regexp_extract_all(text, '[A-Z]')) AS caps, regexp_replace(text, '[aeiou]', '', 'g') AS gone, regexp_extract(text, '([a-z]+)', 1) AS word, regexp_full_match(text, '[^0-9]*') AS plain FROM documents"
)
def fn_regexp(t):
    return t.documents.select("doc_id", L.regexp_count("text", "[A-Z]").as_("caps"), L.regexp_replace("text", "[aeiou]", "").as_("gone"), L.regexp_extract("text", "([a-z]+)", 1).as_("word"), L.regexp_like("text", "[^0-9]*").as_("plain"))


@query(
    "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, week(o_orderdate) AS w, dayofyear(o_orderdate) AS dy, dayofweek(o_orderdate) AS dw, CAST(last_day(o_orderdate) AS VARCHAR) AS ld, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS tm, "
    "CAST(CAST(o_orderdate AS DATE) + 10 AS VARCHAR) AS plus, date_diff('month', o_orderdate, TIMESTAMP '1998-08-02') AS dm, date_diff('day', o_orderdate, TIMESTAMP '1998-08-02') AS dd, date_diff('year', o_orderdate, TIMESTAMP '1998-08-02') AS dyr, strftime(o_orderdate, '%Y/%m/%d') AS f, o_orderdate + INTERVAL 3 HOUR AS h3 FROM orders"
)
def fn_dates(t):
    d, end = "o_orderdate", lit("1998-08-02").cast("timestamp_ntz")
    return t.orders.select(
        "o_orderkey", L.year(d).as_("y"), L.month(d).as_("m"), L.dayofmonth(d).as_("d"), L.quarter(d).as_("q"), L.weekofyear(d).as_("w"), L.dayofyear(d).as_("dy"), L.dayofweek(d).as_("dw"), L.last_day(d).cast("string").as_("ld"), L.date_trunc("month", d).as_("tm"), L.date_add(d, 10).cast("string").as_("plus"), L.datediff("month", d, end).as_("dm"),
        L.datediff("day", d, end).as_("dd"), L.datediff("year", d, end).as_("dyr"), L.date_format(d, "YYYY/MM/DD").as_("f"), L.dateadd("hour", 3, d).as_("h3"),
    )


@query(
    "SELECT vec_id, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS first, list_position(embedding, embedding[3]) - 1 AS pos, len(embedding[2:4]) AS sl, CAST(list_max(embedding) AS DOUBLE) AS mx, list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS ip, "
    "list_distance(CAST(embedding AS DOUBLE[]), list_transform(CAST(embedding AS DOUBLE[]), lambda x: 0.0)) AS l2 FROM embeddings"
)
def fn_arrays_vectors(t):
    e = "embedding"
    zeros = L.transform(e, lambda x: x * 0.0)
    return t.embeddings.select(
        "vec_id", L.array_size(e).as_("n"), L.get(e, 0).cast("double").as_("first"), L.array_position(L.get(e, 2), e).as_("pos"), L.array_size(L.array_slice(e, 1, 4)).as_("sl"), L.array_max(e).cast("double").as_("mx"), L.vector_inner_product(e, e).as_("ip"),
        L.vector_l2_distance(e, zeros).as_("l2"),
    )


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n FROM events WHERE props IS NOT NULL")
def fn_json(t):
    props = L.from_json(col("props"), "map<string,string>")
    return t.events.filter(col("props").is_not_null()).select("event_id", L.get(L.map_values(props), 0).as_("first_value"), L.map_size(props).as_("n"))


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' AND c_acctbal > 0 AS a, c_mktsegment = 'BUILDING' OR c_acctbal > 0 AS o, c_nationkey IS NOT DISTINCT FROM 3 AS e, hash(c_custkey) = hash(c_custkey) AS h FROM customer")
def fn_boolean(t):
    b, p = col("c_mktsegment") == "BUILDING", col("c_acctbal") > 0
    return t.customer.select("c_custkey", L.booland(b, p).as_("a"), L.boolor(b, p).as_("o"), L.equal_null("c_nationkey", lit(3)).as_("e"), (L.hash("c_custkey") == L.hash("c_custkey")).as_("h"))
