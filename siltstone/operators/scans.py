"""Scans, projections, filters and predicates."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from .base import Family

family = Family()
query = family.query


@query("scan_project", "SELECT o_orderkey, o_custkey AS customer, o_totalprice FROM orders")
def scan_project(t):
    return t("orders").select("o_orderkey", F.col("o_custkey").alias("customer"), "o_totalprice")


@query("quoted_identifiers", 'SELECT "o"."o_orderkey" AS "order key", "o"."o_orderstatus" AS "select" FROM orders AS "o" WHERE "o"."o_orderstatus" = \'F\'')
def quoted_identifiers(t):
    return t("orders").where(F.col("`o_orderstatus`") == "F").select(F.col("o_orderkey").alias("order key"), F.col("o_orderstatus").alias("select"))


@query("values_scan", "SELECT * FROM (VALUES (1, 'low'), (2, 'mid'), (3, 'high')) v(rank, tier)")
def values_scan(t):
    return t.spark.createDataFrame([(1, "low"), (2, "mid"), (3, "high")], "rank int, tier string")


@query("select_constant", "SELECT 1 AS one, 'x' AS letter, 2.5::DOUBLE AS number")
def select_constant(t):
    return t.spark.range(1).select(F.lit(1).alias("one"), F.lit("x").alias("letter"), F.lit(2.5).alias("number"))


@query("derived_table", "SELECT d.c_nationkey, d.c_name FROM (SELECT c_nationkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000) d WHERE d.c_nationkey < 10")
def derived_table(t):
    rich = t("customer").where("c_acctbal > 5000").select("c_nationkey", "c_name", "c_acctbal")
    return rich.where("c_nationkey < 10").select("c_nationkey", "c_name")


@query("star_plus_expr", "SELECT *, s_acctbal * 2 AS doubled FROM supplier")
def star_plus_expr(t):
    return t("supplier").select("*", (F.col("s_acctbal") * 2).alias("doubled"))


@query("arith_projection", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, l_quantity - 1 AS less FROM lineitem")
def arith_projection(t):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(price, 6).alias("charge"), (F.col("l_quantity") - 1).alias("less"))


@query("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def select_distinct(t):
    return t("lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("filter_compare", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 40 AND p_size <> 25 AND p_retailprice > 500 AND p_partkey <= 1500")
def filter_compare(t):
    p = t("part")
    return p.where((p.p_size >= 10) & (p.p_size < 40) & (p.p_size != 25) & (p.p_retailprice > 500) & (p.p_partkey <= 1500)).select("p_partkey", "p_size")


@query("filter_boolean", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice > 200000) AND NOT (o_orderpriority = '5-LOW' OR o_custkey < 100)")
def filter_boolean(t):
    o = t("orders")
    return o.where(((o.o_orderstatus == "O") | (o.o_totalprice > 200000)) & ~((o.o_orderpriority == "5-LOW") | (o.o_custkey < 100))).select("o_orderkey")


@query("filter_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def filter_in(t):
    c = t("customer")
    return c.where(c.c_mktsegment.isin("BUILDING", "MACHINERY") & ~c.c_nationkey.isin(1, 2, 3)).select("c_custkey", "c_mktsegment")


@query("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.05 AND l_quantity NOT BETWEEN 10 AND 20")
def filter_between(t):
    li = t("lineitem")
    return li.where(li.l_discount.between(0.02, 0.05) & ~li.l_quantity.between(10, 20)).select("l_orderkey", "l_linenumber")


@query("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE '%9'")
def filter_like(t):
    p = t("part")
    return p.where(p.p_type.like("%A%") & ~p.p_name.like("%9")).select("p_partkey", "p_type")


@query("filter_null", "SELECT event_id, CASE WHEN props IS NULL THEN 0 ELSE 1 END AS has_props FROM events WHERE value IS NOT NULL")
def filter_null(t):
    e = t("events")
    return e.where(e.value.isNotNull()).select("event_id", F.when(e.props.isNull(), 0).otherwise(1).alias("has_props"))


@query("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def semi_in(t):
    big = t("orders").where("o_totalprice > 100000").select("o_custkey")
    return t("customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_not_in(t):
    has = t("orders").where("o_custkey is not null").select("o_custkey")
    return t("customer").join(has, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("semi_exists", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 45)")
def semi_exists(t):
    li = t("lineitem").where("l_quantity > 45")
    return t("supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("anti_not_exists", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_returnflag = 'R')")
def anti_not_exists(t):
    li = t("lineitem").where("l_returnflag = 'R'")
    return t("part").join(li, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


_BOUND = {"<": F.min, "<=": F.min, ">": F.max, ">=": F.max}
_OTHER = {F.min: F.max, F.max: F.min}


def compared_to_all(value, op: str, rows, column: str):
    """``value op ALL (column of rows)``: true for no rows, never true where one is null; one aggregate, whatever the size."""
    bound = _BOUND[op](column)
    of = lambda agg: rows.agg(agg).scalar()
    holds = {"<": value < of(bound), "<=": value <= of(bound), ">": value > of(bound), ">=": value >= of(bound)}[op]
    return (of(F.count("*")) == 0) | ((of(F.count_if(F.col(column).isNull())) == 0) & holds)


def compared_to_any(value, op: str, rows, column: str):
    """``value op ANY (column of rows)``: true where it holds for one of them; not for no rows."""
    bound = rows.agg(_OTHER[_BOUND[op]](column)).scalar()
    return {"<": value < bound, "<=": value <= bound, ">": value > bound, ">=": value >= bound}[op]


def not_in(left, column: str, rows, other: str):
    """Rows of ``left`` for which ``column NOT IN (other of rows)`` is true: all for no rows, none where one is null, else those not null and not among them.

    A hash anti join on the values that are not null; the two counts decide the rest.
    """
    n, nulls = rows.agg(F.count("*")).scalar(), rows.agg(F.count_if(F.col(other).isNull())).scalar()
    kept = left.where((n == 0) | ((nulls == 0) & F.col(column).isNotNull()))
    among = rows.select(F.col(other).alias("among_")).where("among_ is not null")
    return kept.join(among, F.col(column) == F.col("among_"), "left_anti")


@query("quantified_all", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size < 10)")
def quantified_all(t):
    part = t("part")
    return part.where(compared_to_all(F.col("p_retailprice"), ">=", part.where("p_size < 10"), "p_retailprice")).select("p_partkey", "p_retailprice")


@query("quantified_all_of_none", "SELECT p_partkey FROM part WHERE p_retailprice < ALL (SELECT p_retailprice FROM part WHERE p_size < 0)")
def quantified_all_of_none(t):
    part = t("part")
    return part.where(compared_to_all(F.col("p_retailprice"), "<", part.where("p_size < 0"), "p_retailprice")).select("p_partkey")


_SOME_NULL = "SELECT CASE WHEN c_nationkey > 2 THEN c_acctbal END AS x FROM customer"


@query("quantified_all_with_nulls", f"SELECT s_suppkey FROM supplier WHERE s_acctbal <= ALL ({_SOME_NULL})")
def quantified_all_with_nulls(t):
    some = t("customer").select(F.when(F.col("c_nationkey") > 2, F.col("c_acctbal")).alias("x"))
    return t("supplier").where(compared_to_all(F.col("s_acctbal"), "<=", some, "x")).select("s_suppkey")


@query("quantified_any", "SELECT s_suppkey FROM supplier WHERE s_acctbal > ANY (SELECT c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING')")
def quantified_any(t):
    some = t("customer").where("c_mktsegment = 'BUILDING'")
    return t("supplier").where(compared_to_any(F.col("s_acctbal"), ">", some, "c_acctbal")).select("s_suppkey")


@query("quantified_any_with_nulls", f"SELECT s_suppkey FROM supplier WHERE s_acctbal < ANY ({_SOME_NULL})")
def quantified_any_with_nulls(t):
    some = t("customer").select(F.when(F.col("c_nationkey") > 2, F.col("c_acctbal")).alias("x"))
    return t("supplier").where(compared_to_any(F.col("s_acctbal"), "<", some, "x")).select("s_suppkey")


_MAYBE = "SELECT p_partkey, CASE WHEN p_size > 5 THEN p_size END AS s FROM part"


@query("anti_not_in_nulls_left", f"SELECT p_partkey FROM ({_MAYBE}) WHERE s NOT IN (SELECT l_linenumber + 20 FROM lineitem)")
def anti_not_in_nulls_left(t):
    """A null on the left is in no answer, as it is neither in nor not in."""
    maybe = t("part").select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_size")).alias("s"))
    return not_in(maybe, "s", t("lineitem").select((F.col("l_linenumber") + 20).alias("x")), "x").select("p_partkey")


@query("anti_not_in_nulls_right", f"SELECT l_orderkey FROM lineitem WHERE l_linenumber NOT IN (SELECT s FROM ({_MAYBE}))")
def anti_not_in_nulls_right(t):
    """A null on the right leaves no row."""
    maybe = t("part").select(F.when(F.col("p_size") > 5, F.col("p_size")).alias("s"))
    return not_in(t("lineitem"), "l_linenumber", maybe, "s").select("l_orderkey")


@query("anti_not_in_none", "SELECT p_partkey FROM part WHERE CASE WHEN p_size > 5 THEN p_size END NOT IN (SELECT p_size FROM part WHERE p_size < 0)")
def anti_not_in_none(t):
    """Nothing is in an empty set, not even a null."""
    maybe = t("part").select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_size")).alias("s"))
    return not_in(maybe, "s", t("part").where("p_size < 0"), "p_size").select("p_partkey")


_CORRELATED = "SELECT c.c_custkey, (SELECT max(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS largest FROM customer c"


@query("scalar_correlated", _CORRELATED)
def scalar_correlated(t):
    return t.sql(_CORRELATED, "customer", "orders")


@query("having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10 AND max(o_totalprice) > 1000")
def having(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")).where("n > 10 and top > 1000").select("o_custkey", "n")


@query("qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def qualify(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").withColumn("k", F.row_number().over(w)).where("k = 1").select("o_custkey", "o_orderkey")


@query(
    "update_emulation",
    "SELECT p_partkey, CASE WHEN p_size > 40 THEN round(p_retailprice * 0.9, 2) ELSE coalesce(m.price, p_retailprice) END AS p_retailprice FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS price FROM lineitem WHERE l_discount = 0.1 GROUP BY l_partkey) m ON p_partkey = m.l_partkey",
)
def update_emulation(t):
    """An update with a joined source: every row of the target once, changed where the source has its key."""
    source = t("lineitem").where("l_discount = 0.1").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("price"))
    new = F.when(F.col("p_size") > 40, F.round(F.col("p_retailprice") * 0.9, 2)).otherwise(F.coalesce("price", "p_retailprice"))
    return t("part").join(source, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", new.alias("p_retailprice"))


@query("delete_emulation", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderstatus = 'F' AND o_totalprice < 50000, false)")
def delete_emulation(t):
    """What a delete leaves: rows for which its condition is not true."""
    return t("orders").where(~F.coalesce((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 50000), F.lit(False))).select("o_orderkey")


@query(
    "merge_emulation",
    "WITH s AS (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), tgt AS (SELECT c_custkey AS k, CAST(0 AS BIGINT) AS n FROM customer WHERE c_mktsegment <> 'BUILDING') SELECT coalesce(tgt.k, s.k) AS k, CASE WHEN s.k IS NOT NULL AND tgt.k IS NOT NULL THEN tgt.n + s.n WHEN s.k IS NOT NULL THEN s.n ELSE tgt.n END AS n FROM tgt FULL JOIN s ON tgt.k = s.k",
)
def merge_emulation(t):
    """A merge: matched rows are updated, rows of the source alone are inserted, the rest stays."""
    s = t("orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("sk")).agg(F.count("*").alias("sn"))
    tgt = t("customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("tk"), F.lit(0).cast("long").alias("tn"))
    n = F.when(F.col("sk").isNotNull() & F.col("tk").isNotNull(), F.col("tn") + F.col("sn")).when(F.col("sk").isNotNull(), F.col("sn")).otherwise(F.col("tn"))
    return tgt.join(s, F.col("tk") == F.col("sk"), "full").select(F.coalesce("tk", "sk").alias("k"), n.alias("n"))
