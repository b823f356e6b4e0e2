"""Joins of all kinds."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from .base import Family

family = Family()
query = family.query


@query("join_inner", "SELECT c.c_name, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey")
def join_inner(t):
    c, o = t("customer"), t("orders")
    return c.join(o, c.c_custkey == o.o_custkey).select("c_name", "o_totalprice")


@query(
    "join_multiway",
    "SELECT r.r_name, n.n_name, CAST(count(*) AS BIGINT) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name",
)
def join_multiway(t):
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name")
        .agg(F.count("*").alias("n"), F.round(F.sum(revenue), 2).alias("revenue"))
    )


@query("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000")
def join_left(t):
    o = t("orders").where("o_totalprice > 200000")
    return t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("join_right", "SELECT l.l_orderkey, p.p_partkey FROM (SELECT * FROM lineitem WHERE l_quantity = 1) l RIGHT JOIN part p ON l.l_partkey = p.p_partkey")
def join_right(t):
    return t("lineitem").where("l_quantity = 1").join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "right").select("l_orderkey", "p_partkey")


@query("join_full", "SELECT a.c_custkey AS rich, b.o_custkey AS buyer FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 8000) a FULL OUTER JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) b ON a.c_custkey = b.o_custkey")
def join_full(t):
    rich = t("customer").where("c_acctbal > 8000").select(F.col("c_custkey").alias("rich"))
    buyer = t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("buyer")).distinct()
    return rich.join(buyer, F.col("rich") == F.col("buyer"), "full")


@query("join_cross", "SELECT n.n_name, r.r_name FROM nation n CROSS JOIN region r")
def join_cross(t):
    """Two fixed lists of 25 and 5 rows; nothing that grows is ever crossed."""
    return t("nation").crossJoin(t("region")).select("n_name", "r_name")


@query("join_multi_cond", "SELECT l.l_orderkey, l.l_linenumber, s.s_name FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey AND l.l_quantity > 30 AND s.s_acctbal > 0 AND l.l_returnflag = 'R'")
def join_multi_cond(t):
    li, s = t("lineitem").where("l_quantity > 30 and l_returnflag = 'R'"), t("supplier").where("s_acctbal > 0")
    return li.join(s, li.l_suppkey == s.s_suppkey).select("l_orderkey", "l_linenumber", "s_name")


@query("join_theta", "SELECT a.s_suppkey AS less, b.s_suppkey AS more FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def join_theta(t):
    a, b = t("supplier").alias("a"), t("supplier").alias("b")
    return a.join(b, F.expr("a.s_nationkey = b.s_nationkey and a.s_acctbal < b.s_acctbal")).select(F.col("a.s_suppkey").alias("less"), F.col("b.s_suppkey").alias("more"))


def range_join(points, value: str, ranges, low: str, high: str):
    """Pairs with low <= value < high, by equality of bins.

    A range falls into bins as wide as itself, to the next power of two, so it
    meets two of them at most, however wide it is; a point has one bin of each
    width that occurs, of which there are 64 at most.
    """
    width = F.ceil(F.log2(F.greatest(F.col(high) - F.col(low), F.lit(1)).cast("double"))).cast("int")
    wide = ranges.where(F.col(low) < F.col(high)).withColumn("level_", width)
    size = F.pow(F.lit(2.0), F.col("level_"))
    first, last = F.floor(F.col(low) / size).cast("long"), F.floor(F.col(high) / size).cast("long")
    wide = wide.withColumn("bin_", F.explode(F.sequence(first, last)))
    levels = wide.agg(F.collect_set("level_")).scalar()
    dealt = points.where(F.col(value).isNotNull()).withColumn("level_", F.explode(levels)).withColumn("bin_", F.floor(F.col(value) / size).cast("long"))
    both = dealt.join(wide, ["level_", "bin_"]).where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high)))
    return both.drop("level_", "bin_")


@query("join_range", "SELECT p.p_partkey, b.tier FROM part p JOIN (VALUES (0, 300, 'low'), (300, 1000, 'mid'), (1000, 100000, 'high')) b(lo, hi, tier) ON p.p_retailprice >= b.lo AND p.p_retailprice < b.hi")
def join_range(t):
    tiers = t.spark.createDataFrame([(0, 300, "low"), (300, 1000, "mid"), (1000, 100000, "high")], "lo int, hi int, tier string")
    return range_join(t("part").select("p_partkey", "p_retailprice"), "p_retailprice", tiers, "lo", "hi").select("p_partkey", "tier")


_WIDE = "SELECT o_orderkey AS k, o_totalprice - o_orderkey % 97 AS lo, o_totalprice + o_custkey * o_custkey AS hi FROM orders WHERE o_totalprice > 300000"


@query("join_range_mixed_widths", f"SELECT s.s_suppkey, r.k FROM supplier s JOIN ({_WIDE}) r ON s.s_acctbal * 50 >= r.lo AND s.s_acctbal * 50 < r.hi")
def join_range_mixed_widths(t):
    """Ranges from empty to millions wide."""
    wide = t("orders").where("o_totalprice > 300000").selectExpr("o_orderkey AS k", "o_totalprice - o_orderkey % 97 AS lo", "o_totalprice + o_custkey * o_custkey AS hi")
    return range_join(t("supplier").select("s_suppkey", (F.col("s_acctbal") * 50).alias("v")), "v", wide, "lo", "hi").select("s_suppkey", "k")


_LATERAL = "SELECT c.c_custkey, x.o_orderkey, x.o_totalprice FROM customer c, LATERAL (SELECT o_orderkey, o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20) x"


@query("join_lateral", _LATERAL)
def join_lateral(t):
    """A correlated relation in FROM, which becomes a hash join."""
    return t.sql(_LATERAL, "customer", "orders")


def asof_join(left, right, key: str, at: str, value: str, bucket: str = "day"):
    """``left`` with the ``value`` of the last row of ``right`` that has its key and is not later; ``right`` has one row for each key and time, and its rows without a value do not count.

    Rows are sorted within a key's buckets of time, so that a key with very many
    rows is dealt over as many tasks as it has buckets.  What a bucket begins with
    comes from one row for each bucket, and no pairs are made.
    """
    bucketed = lambda df: df.withColumn("bucket_", F.date_trunc(bucket, at))
    names = left.columns
    mine = bucketed(left).select(*names, "bucket_", F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("side_"))
    found = bucketed(right.where(F.col(value).isNotNull())).select(*(F.col(n) if n in (key, at) else F.lit(None).cast(left.schema[n].dataType).alias(n) for n in names), "bucket_", value, F.lit(0).alias("side_"))
    within = Window.partitionBy(key, "bucket_").orderBy(at, "side_").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.union(mine).withColumn(value, F.last(value, ignorenulls=True).over(within)).where("side_ = 1")
    # One row for each bucket of a key: its last value, and from these what came before each.
    every = found.union(mine).groupBy(key, "bucket_").agg(F.max(F.when(F.col("side_") == 0, F.struct(at, value)))[value].alias("last_"))
    before = Window.partitionBy(key).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    starts = every.select(F.col(key).alias("key_"), F.col("bucket_").alias("begin_"), F.last("last_", ignorenulls=True).over(before).alias("start_"))
    out = rows.join(starts, (F.col(key) == F.col("key_")) & (F.col("bucket_") == F.col("begin_")), "left")
    return out.select(*names, F.coalesce(value, "start_").alias(value))


@query(
    "join_asof",
    "SELECT l.event_id, r.event_id AS click_id FROM (SELECT * FROM events WHERE event_type <> 'click') l ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts) r ON l.user_id = r.user_id AND l.ts >= r.ts",
)
def join_asof(t):
    """Each event's last click before it."""
    e = t("events").select("event_id", "ts", "user_id", (F.col("event_type") == "click").alias("is_click"))
    clicks = e.where("is_click").groupBy("user_id", "ts").agg(F.max("event_id").alias("click_id"))
    others = e.where("not is_click").select("event_id", "user_id", "ts")
    return asof_join(others, clicks, "user_id", "ts", "click_id").select("event_id", "click_id")


@query("join_on_in_subquery", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def join_on_in_subquery(t):
    big = t("lineitem").where("l_quantity >= 49").select("l_orderkey")
    o = t("orders").join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("join_comma", "SELECT n.n_name, s.s_name FROM nation n, supplier s WHERE n.n_nationkey = s.s_nationkey")
def join_comma(t):
    return t("nation").join(t("supplier"), F.col("n_nationkey") == F.col("s_nationkey")).select("n_name", "s_name")


@query("join_using", "SELECT doc_id, quality, lang FROM labels JOIN documents USING (doc_id)")
def join_using(t):
    return t("labels").join(t("documents"), on=["doc_id"]).select("doc_id", "quality", "lang")


@query("join_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax > 0.07)")
def join_semi(t):
    return t("orders").join(t("lineitem").where("l_tax > 0.07"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti(t):
    return t("customer").join(t("orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("self_join", "SELECT a.conv_id, a.turn, b.text AS before FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1")
def self_join(t):
    a, b = t("conversations").alias("a"), t("conversations").alias("b")
    return a.join(b, F.expr("a.conv_id = b.conv_id and a.turn = b.turn + 1")).select("a.conv_id", "a.turn", F.col("b.text").alias("before"))


@query(
    "derived_join",
    "SELECT a.n_name, a.customers, b.suppliers FROM (SELECT n_name, CAST(count(*) AS BIGINT) AS customers FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name) a JOIN (SELECT n_name, CAST(count(*) AS BIGINT) AS suppliers FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name) b ON a.n_name = b.n_name",
)
def derived_join(t):
    n = t("nation")
    a = n.join(t("customer"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"))
    b = n.join(t("supplier"), F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_name").agg(F.count("*").alias("suppliers"))
    return a.join(b, "n_name")
