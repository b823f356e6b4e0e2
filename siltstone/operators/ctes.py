"""Common table expressions and statements that make tables and views of queries."""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F

from .base import Family

family = Family()
query = family.query


@query("cte_single", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000) SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM big GROUP BY o_custkey")
def cte_single(t):
    return t("orders").where("o_totalprice > 150000").groupBy("o_custkey").agg(F.count("*").alias("n"))


CHAIN = """
WITH filtered AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F')),
summary AS (SELECT o_custkey AS customer_id, CAST(count(*) AS BIGINT) AS total_orders, round(sum(o_totalprice), 2) AS total_spent FROM filtered GROUP BY o_custkey),
segments AS (SELECT customer_id, total_orders, total_spent, CASE WHEN total_spent > 1000000 THEN 'VIP' WHEN total_spent > 300000 THEN 'Regular' ELSE 'Small' END AS segment FROM summary)
SELECT c.c_name, s.total_orders, s.total_spent, s.segment FROM segments s JOIN customer c ON s.customer_id = c.c_custkey
"""


@query("cte_chain", CHAIN)
def cte_chain(t):
    return t.sql(CHAIN, "orders", "customer")


@query(
    "cte_diamond",
    "WITH base AS (SELECT o_custkey, o_orderstatus, o_totalprice FROM orders), o AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_open FROM base WHERE o_orderstatus = 'O' GROUP BY 1), f AS (SELECT o_custkey, max(o_totalprice) AS top FROM base WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o.o_custkey, o.n_open, f.top FROM o JOIN f ON o.o_custkey = f.o_custkey",
)
def cte_diamond(t):
    """Both branches in one pass and one shuffle, instead of two and a join."""
    both = t("orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("top"))
    return both.where("n_open > 0 and n_done > 0").select("o_custkey", "n_open", "top")


@query("ctas_aggregate", "SELECT l_partkey, round(sum(l_quantity), 2) AS qty, CAST(count(*) AS BIGINT) AS lines FROM lineitem GROUP BY l_partkey")
def ctas_aggregate(t):
    """The query of a CREATE TABLE AS; ``siltstone.sources.sinks`` writes it."""
    return t("lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.count("*").alias("lines"))


_CTAS = """
WITH monthly AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2),
ranked AS (SELECT o_custkey, total, row_number() OVER (PARTITION BY o_custkey ORDER BY total DESC, m) AS k FROM monthly)
SELECT o_custkey, round(total, 2) AS best_month FROM ranked WHERE k = 1
"""


@query("ctas_cte_pipeline", _CTAS)
def ctas_cte_pipeline(t):
    return t.sql(_CTAS, "orders")


_VIEW = """
WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
tiers AS (SELECT c.c_nationkey, CASE WHEN s.total >= 500000 THEN 'gold' WHEN s.total >= 100000 THEN 'silver' ELSE 'bronze' END AS tier FROM customer c JOIN spend s ON c.c_custkey = s.o_custkey)
SELECT n.n_name, t.tier, CAST(count(*) AS BIGINT) AS customers FROM tiers t JOIN nation n ON t.c_nationkey = n.n_nationkey GROUP BY n.n_name, t.tier
"""


@query("view_multi_cte", _VIEW)
def view_multi_cte(t):
    """The view is registered under a name of its own, which goes once its plan is known."""
    name = f"customer_tiers_{uuid.uuid4().hex}"
    t.sql(_VIEW, "orders", "customer", "nation").createTempView(name)
    try:
        return t.spark.table(name)
    finally:
        t.spark.catalog.dropTempView(name)


_RECURSIVE = "WITH RECURSIVE steps(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM steps WHERE n < 20) SELECT n, total FROM steps"


@query("cte_recursive", _RECURSIVE)
def cte_recursive(t):
    return t.spark.sql(_RECURSIVE)
