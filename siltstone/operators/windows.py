"""Window functions."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from .base import Family

family = Family()
query = family.query

def _by_customer():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@query("win_row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders")
def win_row_number(t):
    return t("orders").select("o_orderkey", F.row_number().over(_by_customer()).cast("long").alias("rn"))


@query("win_rank", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS dr FROM part")
def win_rank(t):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"))
    return t("part").select("p_partkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"))


@query("win_percent_rank", "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 9) AS pr, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 9) AS cd FROM customer")
def win_percent_rank(t):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal")
    return t("customer").select("c_custkey", F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


@query("win_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2, 0) OVER w AS next2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def win_lag_lead(t):
    return t("orders").select("o_orderkey", F.lag("o_totalprice").over(_by_customer()).alias("prev"), F.lead("o_totalprice", 2, 0.0).over(_by_customer()).alias("next2"))


@query(
    "win_first_last",
    "SELECT o_orderkey, first_value(o_totalprice) OVER w AS first_price, last_value(o_totalprice) OVER w AS last_price, nth_value(o_totalprice, 2) OVER w AS second_price FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
)
def win_first_last(t):
    w = _by_customer().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    price = "o_totalprice"
    return t("orders").select("o_orderkey", F.first(price).over(w).alias("first_price"), F.last(price).over(w).alias("last_price"), F.nth_value(price, 2).over(w).alias("second_price"))


@query("win_agg_partition", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def win_agg_partition(t):
    total = F.sum("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / total, 6).alias("share"))


@query("win_running_total", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def win_running_total(t):
    return t("orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(_by_customer().rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


@query("win_moving_average", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS moving FROM orders")
def win_moving_average(t):
    return t("orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(_by_customer().rowsBetween(-2, 1)), 4).alias("moving"))


@query("win_range_frame", "SELECT p_partkey, CAST(count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS BIGINT) AS near FROM part")
def win_range_frame(t):
    w = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 5)
    return t("part").select("p_partkey", F.count("*").over(w).alias("near"))


@query("win_ntile", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS BIGINT) AS quartile FROM customer")
def win_ntile(t):
    w = Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")
    return t("customer").select("c_custkey", F.ntile(4).over(w).cast("long").alias("quartile"))


_MONTHS = "SELECT c_mktsegment AS segment, strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"


def _months(t):
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("segment"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("win_over_agg", f"WITH m AS ({_MONTHS}) SELECT segment, month, total, CAST(rank() OVER (PARTITION BY segment ORDER BY total DESC, month) AS BIGINT) AS place FROM m")
def win_over_agg(t):
    w = Window.partitionBy("segment").orderBy(F.desc("total"), "month")
    return _months(t).withColumn("place", F.rank().over(w).cast("long"))


@query("win_growth_rate", f"WITH m AS ({_MONTHS}) SELECT segment, month, round((total - lag(total) OVER w) / lag(total) OVER w, 6) AS growth FROM m WINDOW w AS (PARTITION BY segment ORDER BY month)")
def win_growth_rate(t):
    before = F.lag("total").over(Window.partitionBy("segment").orderBy("month"))
    return _months(t).select("segment", "month", F.round((F.col("total") - before) / before, 6).alias("growth"))


@query("topk_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3")
def topk_per_group(t):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t("customer").withColumn("k", F.row_number().over(w)).where("k <= 3").select("c_nationkey", "c_custkey")
