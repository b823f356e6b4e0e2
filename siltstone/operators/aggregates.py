"""Aggregation."""

from __future__ import annotations

import pyspark.sql.functions as F

from .base import Family

family = Family()
query = family.query


@query("agg_count", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(value) AS BIGINT) AS n_value FROM events GROUP BY event_type")
def agg_count(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("n_value"))


@query("agg_count_distinct", "SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY l_returnflag")
def agg_count_distinct(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@query("agg_basic", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_basic(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.min("l_discount").alias("min_disc"), F.max("l_tax").alias("max_tax")
    )


@query("agg_stddev", "SELECT c_mktsegment, round(stddev(c_acctbal), 4) AS sd, round(variance(c_acctbal), 2) AS var FROM customer GROUP BY c_mktsegment")
def agg_stddev(t):
    return t("customer").groupBy("c_mktsegment").agg(F.round(F.stddev("c_acctbal"), 4).alias("sd"), F.round(F.variance("c_acctbal"), 2).alias("var"))


@query("agg_approx_distinct")
def agg_approx_distinct(t):
    """A HyperLogLog++ sketch, within 5 % (one standard error); no SQL gives the same estimate."""
    return t("lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.05).alias("parts"))


@query("agg_string", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey")
def agg_string(t):
    return t("nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("nations"))


@query("agg_array_distinct", "SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def agg_array_distinct(t):
    return t("part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), "|").alias("types"))


@query(
    "group_by_expr",
    "SELECT CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'small' END AS size, strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2",
)
def group_by_expr(t):
    size = F.when(F.col("o_totalprice") > 200000, "large").when(F.col("o_totalprice") > 50000, "medium").otherwise("small")
    return t("orders").groupBy(size.alias("size"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("agg_global", "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty, max(l_extendedprice) AS top FROM lineitem")
def agg_global(t):
    return t("lineitem").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.max("l_extendedprice").alias("top"))


@query("agg_expr", "SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 4) AS unit, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned FROM lineitem GROUP BY l_suppkey")
def agg_expr(t):
    unit = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_quantity")
    return t("lineitem").groupBy("l_suppkey").agg(F.round(unit, 4).alias("unit"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"))


@query("agg_filter", "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS finished, CAST(count(*) FILTER (WHERE o_totalprice > 100000) AS BIGINT) AS large FROM orders GROUP BY o_orderpriority")
def agg_filter(t):
    return t("orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


_GROUPED = "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY"


@query("rollup", f"{_GROUPED} ROLLUP (l_returnflag, l_linestatus)")
def rollup(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("cube", f"{_GROUPED} CUBE (l_returnflag, l_linestatus)")
def cube(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("grouping_sets", f"{_GROUPED} GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(t):
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return t("lineitem").groupingSets([[a], [b], []], a, b).agg(F.count("*").alias("n"))


SALTS = 16


@query("agg_salted", "SELECT source, CAST(count(*) AS BIGINT) AS documents, CAST(count(DISTINCT lang) AS BIGINT) AS langs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def agg_salted(t):
    """A hot source is dealt over SALTS groups, whose sums are then added; its languages are counted once for the source."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    parts = t("documents").groupBy("source", "lang", salt.alias("salt")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    pairs = parts.groupBy("source", "lang").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    return pairs.groupBy("source").agg(F.sum("n").alias("documents"), F.count("lang").alias("langs"), F.sum("c").alias("chars"))
