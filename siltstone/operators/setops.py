"""Sorting, limits and set operations."""

from __future__ import annotations

import pyspark.sql.functions as F

from .base import Family

family = Family()
query = family.query


@query("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_limit(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("sort_nulls", "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON c_custkey = o_custkey) ORDER BY o_orderkey ASC NULLS FIRST, c_custkey DESC")
def sort_nulls(t):
    big = t("orders").where("o_totalprice > 250000")
    both = t("customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")
    return both.orderBy(F.col("o_orderkey").asc_nulls_first(), F.desc("c_custkey"))


@query("limit_offset", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice, p_partkey LIMIT 10 OFFSET 5")
def limit_offset(t):
    return t("part").orderBy("p_retailprice", "p_partkey").select("p_partkey", "p_name").offset(5).limit(10)


@query("union_all", "SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier UNION ALL SELECT p_partkey, p_name, 'part' FROM part")
def union_all(t):
    pick = lambda name, key, label: t(name).select(F.col(key).alias("id"), F.col(label).alias("name"), F.lit(name).alias("kind"))
    return pick("customer", "c_custkey", "c_name").union(pick("supplier", "s_suppkey", "s_name")).union(pick("part", "p_partkey", "p_name"))


@query("union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t("customer").select(F.col("c_nationkey").alias("nation")).union(t("supplier").select("s_nationkey")).distinct()


@query("intersect", "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 48 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount = 0.1")
def intersect(t):
    li = t("lineitem")
    return li.where("l_quantity > 48").select(F.col("l_suppkey").alias("k")).intersect(li.where("l_discount = 0.1").select("l_suppkey"))


@query("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_distinct(t):
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").select("o_custkey"))


@query("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersectAll(t("supplier").select("s_nationkey"))


@query("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).exceptAll(t("supplier").select("s_nationkey"))


@query(
    "union_in_cte",
    "WITH parties AS (SELECT c_nationkey AS nation, c_acctbal AS owes, NULL::DOUBLE AS owed FROM customer UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier) SELECT nation, round(sum(owes), 2) AS owes, round(sum(owed), 2) AS owed FROM parties GROUP BY nation",
)
def union_in_cte(t):
    none = F.lit(None).cast("double")
    one = t("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("owes"), none.alias("owed"))
    two = t("supplier").select("s_nationkey", none, "s_acctbal")
    return one.union(two).groupBy("nation").agg(F.round(F.sum("owes"), 2).alias("owes"), F.round(F.sum("owed"), 2).alias("owed"))
