"""Scalar functions."""

from __future__ import annotations

import pyspark.sql.functions as F

from siltstone.operators.base import Family

family = Family()
query = family.query


@query("case_tiers", "SELECT c_custkey, CASE WHEN c_acctbal > 7500 THEN 'gold' WHEN c_acctbal > 2500 THEN 'silver' WHEN c_acctbal >= 0 THEN 'bronze' ELSE 'debt' END AS tier FROM customer")
def case_tiers(t):
    b = F.col("c_acctbal")
    return t("customer").select("c_custkey", F.when(b > 7500, "gold").when(b > 2500, "silver").when(b >= 0, "bronze").otherwise("debt").alias("tier"))


@query("coalesce_nullif", "SELECT c_custkey, coalesce(o.top, 0) AS top, nullif(c_mktsegment, 'BUILDING') AS other, ifnull(nullif(c_nationkey, 0), -1) AS nation, CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END AS positive FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1) o ON c_custkey = o.o_custkey")
def coalesce_nullif(t):
    o = t("orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    c = t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(
        "c_custkey", F.coalesce("top", F.lit(0.0)).alias("top"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("other"), F.nvl(F.nullif("c_nationkey", F.lit(0)), F.lit(-1)).alias("nation"), F.expr("if(c_acctbal > 0, 'yes', 'no')").alias("positive")
    )


@query(
    "string_funcs",
    "SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, substring(c_name, 1, 4) AS head, CAST(length(c_name) AS BIGINT) AS size, CAST(instr(c_name, '0') AS BIGINT) AS at, c_name || '/' || c_mktsegment AS joined, concat_ws('-', c_mktsegment, c_name) AS ws, regexp_matches(c_name, '[13579]$') AS odd, replace(c_name, '0', '') AS bare, trim('  x ') AS trimmed, reverse(c_mktsegment) AS back FROM customer",
)
def string_funcs(t):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return t("customer").select(
        "c_custkey", F.upper(n).alias("up"), F.lower(m).alias("low"), F.substring(n, 1, 4).alias("head"), F.length(n).cast("long").alias("size"), F.instr(n, "0").cast("long").alias("at"), F.concat(n, F.lit("/"), m).alias("joined"),
        F.concat_ws("-", m, n).alias("ws"), n.rlike("[13579]$").alias("odd"), F.replace(n, F.lit("0"), F.lit("")).alias("bare"), F.trim(F.lit("  x ")).alias("trimmed"), F.reverse(m).alias("back"),
    )


@query(
    "date_funcs",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day, strftime(o_orderdate, '%Y-%m') AS label, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS due, strftime(last_day(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS month_end, CAST(quarter(o_orderdate) AS BIGINT) AS q FROM orders",
)
def date_funcs(t):
    d = F.col("o_orderdate")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t("orders").select(
        "o_orderkey", F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), F.dayofmonth(d).cast("long").alias("d"), text(F.date_trunc("month", d)).alias("first_day"), F.date_format(d, "yyyy-MM").alias("label"),
        F.datediff(d.cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("days"), text(d + F.expr("INTERVAL 30 DAYS")).alias("due"), text(F.last_day(d.cast("date"))).alias("month_end"), F.quarter(d).cast("long").alias("q"),
    )


@query("math_funcs", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 3) AS r, CAST(floor(l_quantity / 3) AS BIGINT) AS f, CAST(ceil(l_discount * 10) AS BIGINT) AS c, l_orderkey % 7 AS m, abs(l_discount - 0.05) > 0.02 AS far, round(sqrt(l_quantity), 6) AS root, round(power(l_quantity, 2), 3) AS square, round(ln(l_quantity), 9) AS log FROM lineitem")
def math_funcs(t):
    q = F.col("l_quantity")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 7, 3).alias("r"), F.floor(q / 3).alias("f"), F.ceil(F.col("l_discount") * 10).alias("c"), (F.col("l_orderkey") % 7).alias("m"), (F.abs(F.col("l_discount") - 0.05) > 0.02).alias("far"),
        F.round(F.sqrt(q), 6).alias("root"), F.round(F.pow(q, F.lit(2)), 3).alias("square"), F.round(F.ln(q), 9).alias("log"),
    )


@query("cast_funcs", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS text, CAST(o_orderkey AS DOUBLE) AS number, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST('42' AS INTEGER) AS answer, TRY_CAST(o_orderstatus AS INTEGER) AS none FROM orders")
def cast_funcs(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", k.cast("string").alias("text"), k.cast("double").alias("number"), F.col("o_orderdate").cast("date").cast("string").alias("day"), F.lit("42").cast("int").alias("answer"), F.col("o_orderstatus").try_cast("int").alias("none"))


@query("json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS number FROM events")
def json_extract(t):
    k = F.get_json_object("props", "$.k")
    return t("events").select("event_id", k.alias("k"), k.try_cast("long").alias("number"))


@query("array_explode", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
def array_explode(t):
    return t("part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("word"))


@query("array_higher_order", "SELECT l_orderkey, round(list_sum(list_transform(list(l_quantity), lambda x: x * x)), 2) AS squares, CAST(len(list_filter(list(l_discount), lambda x: x > 0.05)) AS BIGINT) AS reduced FROM lineitem GROUP BY l_orderkey")
def array_higher_order(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"), F.collect_list("l_discount").alias("d"))
    squares = F.aggregate(F.transform("q", lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    return lines.select("l_orderkey", F.round(squares, 2).alias("squares"), F.size(F.filter("d", lambda x: x > 0.05)).cast("long").alias("reduced"))
