"""Provenance queries: over a fixed set of statements, and over graphs in the tables.

The expected rows of the first kind were written by hand from the statements;
those of the second come from recursive SQL over the same tables.
"""

from __future__ import annotations

import pyspark.sql.functions as F

from siltstone.lineage import combine, graph
from siltstone.lineage.corpus import Corpus, parse_statements
from siltstone.lineage.events import event_table
from siltstone.lineage.naming import canonical_names
from siltstone.operators.base import Family

family = Family()
query = family.query

STATEMENTS: list[tuple[int, str]] = [
    (1, "CREATE TABLE filtered_orders AS SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus NOT IN ('P', 'X')"),
    (2, "CREATE TABLE customer_summary AS SELECT o_custkey AS customer_id, count(*) AS total_orders, sum(o_totalprice) AS total_spent FROM filtered_orders GROUP BY o_custkey HAVING count(*) > 1"),
    (3, "CREATE TABLE customer_segments AS SELECT customer_id, total_spent, CASE WHEN total_spent > 100000 THEN 'VIP' ELSE 'Regular' END AS segment FROM customer_summary"),
    (4, "WITH big AS (SELECT customer_id, segment FROM customer_segments WHERE segment = 'VIP'), named AS (SELECT c.c_name, b.segment FROM customer c JOIN big b ON c.c_custkey = b.customer_id) SELECT * FROM named ORDER BY c_name LIMIT 10"),
    (5, "SELECT l.l_partkey, p.p_name, sum(l.l_quantity) AS qty FROM lineitem l LEFT OUTER JOIN part p ON l.l_partkey = p.p_partkey AND p.p_size > 5 GROUP BY l.l_partkey, p.p_name"),
    (6, "CREATE TABLE order_ranks AS SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rn FROM filtered_orders"),
    (7, "SELECT s.segment, n.n_name FROM customer_segments s JOIN customer c ON s.customer_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_name IS NOT NULL"),
    (8, "SELECT c_custkey AS id, c_name AS name, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 's' FROM supplier"),
    (9, "WITH a AS (SELECT x FROM b), b AS (SELECT x FROM a) SELECT x FROM a"),
    (10, "SELECT FROM WHERE"),
    (11, "INSERT INTO vip_orders SELECT o.o_orderkey FROM orders o WHERE o.o_custkey IN (SELECT v.customer_id FROM customer_segments v WHERE v.segment = 'VIP')"),
    (12, "WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM sales.orders GROUP BY o_custkey), top AS (SELECT o_custkey, total FROM spend WHERE total > 10), both AS (SELECT s.o_custkey, s.total, t.total AS top_total FROM spend s LEFT JOIN top t ON s.o_custkey = t.o_custkey) SELECT b.o_custkey, b.top_total, o.o_orderkey FROM both b JOIN orders o ON b.o_custkey = o.o_custkey"),
]


def _corpus(t) -> Corpus:
    rows = t.spark.createDataFrame(STATEMENTS, "stmt_id long, sql string").repartition(2)
    return Corpus(parse_statements(rows))


def _values(columns: str, rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) v({columns})"


def _longs(columns: list[str], sql: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in columns)}) FROM ({sql})"


R = "QUERY_RESULT"
TABLE_EDGES = [
    (1, "filtered_orders", "orders"), (2, "customer_summary", "filtered_orders"), (3, "customer_segments", "customer_summary"), (4, "big", "customer_segments"), (4, R, "customer"), (4, R, "big"), (5, R, "lineitem"), (5, R, "part"),
    (6, "order_ranks", "filtered_orders"), (7, R, "customer_segments"), (7, R, "customer"), (7, R, "nation"), (8, R, "customer"), (8, R, "supplier"), (11, "vip_orders", "orders"), (11, "vip_orders", "customer_segments"),
    (12, "spend", "sales.orders"), (12, "top", "spend"), (12, "both", "spend"), (12, "both", "top"), (12, R, "both"), (12, R, "sales.orders"),
]
_EDGES_SQL = _longs(["stmt_id"], _values("stmt_id, target, source", TABLE_EDGES))


@query("lineage_table_edges", _EDGES_SQL)
def lineage_table_edges(t):
    return _corpus(t).table_edges()


@query(
    "lineage_statements",
    _longs(["stmt_id", "n_errors"], _values("stmt_id, sql_type, target, n_errors", [(1, "CTAS", "filtered_orders", 0), (2, "CTAS", "customer_summary", 0), (3, "CTAS", "customer_segments", 0), (4, "CTE", None, 0), (5, "SELECT", None, 0), (6, "CTAS", "order_ranks", 0), (7, "SELECT", None, 0), (8, "UNION", None, 0), (9, None, None, 1), (10, None, None, 1), (11, "INSERT", "vip_orders", 0), (12, "CTE", None, 0)])),
)
def lineage_statements(t):
    return _corpus(t).statements().select("stmt_id", "sql_type", "target", F.size("errors").cast("long").alias("n_errors"))


COLUMN_EDGES = [
    (1, "filtered_orders.o_orderkey", "orders.o_orderkey", "DIRECT"), (1, "filtered_orders.o_custkey", "orders.o_custkey", "DIRECT"), (1, "filtered_orders.o_totalprice", "orders.o_totalprice", "DIRECT"),
    (2, "customer_summary.customer_id", "filtered_orders.o_custkey", "DIRECT"), (2, "customer_summary.total_orders", None, "AGGREGATE"), (2, "customer_summary.total_spent", "filtered_orders.o_totalprice", "AGGREGATE"),
    (3, "customer_segments.customer_id", "customer_summary.customer_id", "DIRECT"), (3, "customer_segments.total_spent", "customer_summary.total_spent", "DIRECT"), (3, "customer_segments.segment", "customer_summary.total_spent", "CASE"),
    (4, "big.customer_id", "customer_segments.customer_id", "DIRECT"), (4, "big.segment", "customer_segments.segment", "DIRECT"), (4, f"{R}.c_name", "customer.c_name", "DIRECT"), (4, f"{R}.segment", "big.segment", "DIRECT"),
    (5, f"{R}.l_partkey", "lineitem.l_partkey", "DIRECT"), (5, f"{R}.p_name", "part.p_name", "DIRECT"), (5, f"{R}.qty", "lineitem.l_quantity", "AGGREGATE"),
    (6, "order_ranks.o_orderkey", "filtered_orders.o_orderkey", "DIRECT"), (6, "order_ranks.rn", "filtered_orders.o_custkey", "WINDOW_FUNCTION"), (6, "order_ranks.rn", "filtered_orders.o_totalprice", "WINDOW_FUNCTION"),
    (7, f"{R}.segment", "customer_segments.segment", "DIRECT"), (7, f"{R}.n_name", "nation.n_name", "DIRECT"),
    (8, f"{R}.id", "customer.c_custkey", "DIRECT"), (8, f"{R}.name", "customer.c_name", "DIRECT"), (8, f"{R}.kind", "LITERAL", "LITERAL"), (8, f"{R}.id", "supplier.s_suppkey", "DIRECT"), (8, f"{R}.name", "supplier.s_name", "DIRECT"), (8, f"{R}.kind", "LITERAL", "LITERAL"),
    (11, "vip_orders.o_orderkey", "orders.o_orderkey", "DIRECT"),
    (12, "spend.o_custkey", "sales.orders.o_custkey", "DIRECT"), (12, "spend.total", "sales.orders.o_totalprice", "AGGREGATE"), (12, "top.o_custkey", "spend.o_custkey", "DIRECT"), (12, "top.total", "spend.total", "DIRECT"),
    (12, "both.o_custkey", "spend.o_custkey", "DIRECT"), (12, "both.total", "spend.total", "DIRECT"), (12, "both.top_total", "top.total", "DIRECT"),
    (12, f"{R}.o_custkey", "both.o_custkey", "DIRECT"), (12, f"{R}.top_total", "both.top_total", "DIRECT"), (12, f"{R}.o_orderkey", "sales.orders.o_orderkey", "DIRECT"),
]


@query("lineage_column_edges", _longs(["stmt_id"], _values("stmt_id, target, source, kind", COLUMN_EDGES)))
def lineage_column_edges(t):
    c = _corpus(t).column_edges()
    return c.select("stmt_id", F.concat_ws(".", "target_entity", "target_column").alias("target"), F.when(F.col("source_column").isNotNull(), F.concat_ws(".", "source_entity", "source_column")).alias("source"), "kind")


@query(
    "lineage_transformations",
    _longs(
        ["stmt_id", "n_joins", "n_filters"],
        _values(
            "stmt_id, source_table, target_table, transformation_type, group_by, n_joins, n_filters",
            [
                (1, "orders", "filtered_orders", "FILTER", "", 0, 2), (2, "filtered_orders", "customer_summary", "GROUP_BY", "o_custkey", 0, 0), (3, "customer_summary", "customer_segments", "SELECT", "", 0, 0), (4, "customer_segments", "big", "FILTER", "", 0, 1), (4, "customer", R, "JOIN", "", 1, 0), (4, "big", R, "JOIN", "", 1, 0),
                (5, "lineitem", R, "JOIN", "l.l_partkey,p.p_name", 1, 0), (5, "part", R, "JOIN", "l.l_partkey,p.p_name", 1, 0), (6, "filtered_orders", "order_ranks", "SELECT", "", 0, 0), (7, "customer_segments", R, "JOIN", "", 2, 1), (7, "customer", R, "JOIN", "", 2, 1), (7, "nation", R, "JOIN", "", 2, 1),
                (8, "customer", R, "UNION ALL", "", 0, 0), (8, "supplier", R, "UNION ALL", "", 0, 0), (11, "orders", "vip_orders", "FILTER", "", 0, 1), (12, "sales.orders", "spend", "GROUP_BY", "o_custkey", 0, 0), (12, "spend", "top", "FILTER", "", 0, 1), (12, "spend", "both", "JOIN", "", 1, 0), (12, "top", "both", "JOIN", "", 1, 0),
                (12, "both", R, "JOIN", "", 1, 0), (12, "sales.orders", R, "JOIN", "", 1, 0),
            ],
        ),
    ),
)
def lineage_transformations(t):
    x = _corpus(t).transformations()
    return x.select("stmt_id", "source_table", "target_table", "transformation_type", F.array_join("group_by_columns", ",").alias("group_by"), F.size("joins").cast("long").alias("n_joins"), F.size("filter_conditions").cast("long").alias("n_filters"))


@query(
    "lineage_filters",
    _longs(
        ["stmt_id"],
        _values(
            "stmt_id, target_table, column, operator, value",
            [
                (1, "filtered_orders", "orders.o_totalprice", ">", "1000"), (1, "filtered_orders", "orders.o_orderstatus", "NOT IN", "('P', 'X')"), (4, "big", "customer_segments.segment", "=", "'VIP'"), (7, R, "nation.n_name", "IS NOT NULL", None),
                (11, "vip_orders", "orders.o_custkey", "IN", "SELECT v.customer_id FROM customer_segments v WHERE v.segment = 'VIP'"), (12, "top", "spend.total", ">", "10"),
            ],
        ).replace("target_table, column,", 'target_table, "column",'),
    ),
)
def lineage_filters(t):
    return _corpus(t).filters().select("stmt_id", "target_table", "column", "operator", "value")


@query("lineage_having", _longs(["stmt_id"], _values('stmt_id, target_table, "column", operator, value', [(2, "customer_summary", "count(*)", ">", "1")])))
def lineage_having(t):
    return _corpus(t).filters("having_conditions").select("stmt_id", "target_table", "column", "operator", "value")


@query(
    "lineage_joins",
    _longs(
        ["stmt_id"],
        _values(
            "stmt_id, join_type, right_table, left_column, operator, right_column",
            [
                (4, "JOIN", "big", "customer.c_custkey", "=", "big.customer_id"), (5, "LEFT OUTER JOIN", "part", "lineitem.l_partkey", "=", "part.p_partkey"), (5, "LEFT OUTER JOIN", "part", "part.p_size", ">", "5"),
                (7, "JOIN", "customer", "customer_segments.customer_id", "=", "customer.c_custkey"), (7, "JOIN", "nation", "customer.c_nationkey", "=", "nation.n_nationkey"), (12, "LEFT JOIN", "top", "spend.o_custkey", "=", "top.o_custkey"), (12, "JOIN", "sales.orders", "both.o_custkey", "=", "sales.orders.o_custkey"),
            ],
        ),
    ),
)
def lineage_joins(t):
    return _corpus(t).joins().drop("target_table")


@query("lineage_windows", _longs(["stmt_id"], _values("stmt_id, target_column, function, partition_by, order_by", [(6, "rn", "ROW_NUMBER", "o_custkey", "o_totalprice DESC")])))
def lineage_windows(t):
    w = _corpus(t).column_edges().where("window is not null")
    return w.select("stmt_id", "target_column", F.col("window.function_name").alias("function"), F.array_join("window.partition_by", ",").alias("partition_by"), F.array_join("window.order_by", ",").alias("order_by")).distinct()


@query("lineage_cases", _longs(["stmt_id"], _values("stmt_id, target_column, condition, result, otherwise", [(3, "segment", "total_spent > 100000", "'VIP'", "'Regular'")])))
def lineage_cases(t):
    c = _corpus(t).column_edges().where("case is not null").select("stmt_id", "target_column", F.explode("case.whens").alias("w"), F.col("case.else_value").alias("otherwise"))
    return c.select("stmt_id", "target_column", F.col("w.when").alias("condition"), F.col("w.then").alias("result"), "otherwise").distinct()


@query("lineage_aggregates", _longs(["stmt_id"], _values("stmt_id, target_column, function, argument", [(2, "total_orders", "COUNT", "*"), (2, "total_spent", "SUM", "o_totalprice"), (5, "qty", "SUM", "l.l_quantity"), (12, "total", "SUM", "o_totalprice")])))
def lineage_aggregates(t):
    a = _corpus(t).column_edges().where("aggregate is not null")
    return a.select("stmt_id", "target_column", F.col("aggregate.function_type").alias("function"), F.col("aggregate.column").alias("argument")).distinct()


_REACH = "WITH RECURSIVE e AS ({edges}), r AS (SELECT stmt_id, {a} AS root, {b} AS node, 1 AS d FROM e UNION SELECT r.stmt_id, r.root, e.{b}, r.d + 1 FROM r JOIN e ON r.stmt_id = e.stmt_id AND r.node = e.{a} WHERE r.d < 20) SELECT stmt_id, root, node, CAST(min(d) AS BIGINT) AS depth FROM r GROUP BY ALL"


@query("lineage_upstream_closure", _REACH.format(edges=_EDGES_SQL, a="target", b="source"))
def lineage_upstream_closure(t):
    return graph.closure(_corpus(t).table_edges(), "stmt_id", "target", "source").withColumn("depth", F.col("depth").cast("long"))


@query("lineage_downstream_closure", _REACH.format(edges=_EDGES_SQL, a="source", b="target"))
def lineage_downstream_closure(t):
    return graph.closure(_corpus(t).table_edges(), "stmt_id", "source", "target").withColumn("depth", F.col("depth").cast("long"))


_ALL_EDGES = f"SELECT DISTINCT CAST(0 AS BIGINT) AS stmt_id, target, source FROM ({_EDGES_SQL}) WHERE target <> 'QUERY_RESULT'"


@query("lineage_corpus_closure", _REACH.format(edges=_ALL_EDGES, a="target", b="source"))
def lineage_corpus_closure(t):
    """Across statements: tables meet by their names."""
    e = _corpus(t).table_edges().where("target <> 'QUERY_RESULT'").select(F.lit(0).cast("long").alias("stmt_id"), "target", "source").distinct()
    return graph.closure(e, "stmt_id", "target", "source").withColumn("depth", F.col("depth").cast("long"))


@query("lineage_depth", f"WITH RECURSIVE e AS ({_EDGES_SQL}), r AS (SELECT DISTINCT stmt_id, source AS node, 0 AS d FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.stmt_id = e.stmt_id AND x.target = e.source) UNION SELECT r.stmt_id, e.target, r.d + 1 FROM r JOIN e ON r.stmt_id = e.stmt_id AND r.node = e.source) SELECT stmt_id, node, CAST(max(d) AS BIGINT) AS depth FROM r GROUP BY ALL")
def lineage_depth(t):
    return graph.depths(_corpus(t).table_edges(), "stmt_id", "source", "target").withColumn("depth", F.col("depth").cast("long"))


@query("lineage_roots_leaves", f"WITH e AS ({_EDGES_SQL}) SELECT DISTINCT stmt_id, source AS node, 'root' AS place FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.stmt_id = e.stmt_id AND x.target = e.source) UNION ALL SELECT DISTINCT stmt_id, target, 'leaf' FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.stmt_id = e.stmt_id AND x.source = e.target)")
def lineage_roots_leaves(t):
    e = _corpus(t).table_edges()
    return graph.roots(e, "stmt_id", "source", "target").withColumn("place", F.lit("root")).union(graph.leaves(e, "stmt_id", "source", "target").withColumn("place", F.lit("leaf")))


@query("lineage_cycle_detect", _longs(["stmt_id"], _values("stmt_id, error", [(9, "CircularDependencyError: Circular CTE dependency detected: a -> b -> a")])))
def lineage_cycle_detect(t):
    return _corpus(t).statements().select("stmt_id", F.explode("errors").alias("error")).where(F.col("error").startswith("CircularDependencyError"))


@query("lineage_canonical_names", _longs(["k"], _values("k, name, canonical", [(1, "orders", "hive.sales.orders"), (1, "sales.orders", "hive.sales.orders"), (1, '"hive"."sales"."orders"', "hive.sales.orders"), (1, "part", "part"), (2, "orders", "orders")])))
def lineage_canonical_names(t):
    rows = t.spark.createDataFrame([(1, "orders"), (1, "sales.orders"), (1, '"hive"."sales"."orders"'), (1, "part"), (2, "orders")], "k long, name string")
    return canonical_names(rows, "k")


@query("lineage_cte_order", _longs(["stmt_id", "level"], _values("stmt_id, name, level", [(4, "big", 1), (4, "named", 2), (12, "spend", 1), (12, "top", 2), (12, "both", 3)])))
def lineage_cte_order(t):
    return _corpus(t).cte_order().withColumn("level", F.col("level").cast("long"))


@query("lineage_passthrough_elimination", _longs(["stmt_id"], _values("stmt_id, name", [(4, "named")])))
def lineage_passthrough_elimination(t):
    return _corpus(t).parsed.select("stmt_id", F.explode("eliminated").alias("name"))


@query("lineage_union_positions", _longs(["ordinal", "branch"], _values("ordinal, branch, name, source", [(0, 0, "id", "c_custkey"), (1, 0, "name", "c_name"), (2, 0, "kind", "LITERAL"), (0, 1, "id", "s_suppkey"), (1, 1, "name", "s_name"), (2, 1, "kind", "LITERAL")])))
def lineage_union_positions(t):
    return _corpus(t).column_edges().where("stmt_id = 8").select(F.col("ordinal").cast("long"), F.col("branch").cast("long"), F.col("target_column").alias("name"), F.col("source_column").alias("source"))


def _links(c: Corpus):
    made = combine.producers(c.table_edges(), c.statements())
    return combine.query_edges(made, combine.consumers(c.table_edges(), c.statements(), c.entities()))


LINKS = [("filtered_orders", 1, 2), ("filtered_orders", 1, 6), ("customer_summary", 2, 3), ("customer_segments", 3, 4), ("customer_segments", 3, 7), ("customer_segments", 3, 11)]
_LINKS_SQL = _longs(["producer", "consumer"], _values("table_name, producer, consumer", LINKS))


@query("lineage_producers_consumers", _LINKS_SQL)
def lineage_producers_consumers(t):
    return _links(_corpus(t))


@query("lineage_query_chains", f"WITH RECURSIVE e AS ({_LINKS_SQL}), r AS (SELECT producer AS root, consumer AS node, 1 AS d FROM e UNION SELECT r.root, e.consumer, r.d + 1 FROM r JOIN e ON r.node = e.producer) SELECT root, node, CAST(min(d) AS BIGINT) AS depth FROM r GROUP BY ALL")
def lineage_query_chains(t):
    links = _links(_corpus(t)).select(F.lit(0).alias("k"), "producer", "consumer")
    return graph.closure(links, "k", "producer", "consumer").select("root", "node", F.col("depth").cast("long").alias("depth"))


@query("lineage_isolated", "SELECT CAST(k AS BIGINT) AS stmt_id FROM (VALUES (5), (8), (9), (10), (12)) v(k)")
def lineage_isolated(t):
    c = _corpus(t)
    return combine.isolated(c.statements(), _links(c))


@query("lineage_events", f"SELECT 'query_' || stmt_id AS query_id, source AS source_table, target AS target_table, 'table_' || replace(source, '.', '_') AS source_id, 'table_' || replace(target, '.', '_') AS target_id, 'PERSISTENT' AS state FROM ({_EDGES_SQL})")
def lineage_events(t):
    c = _corpus(t)
    return event_table(c.table_edges(), c.entities()).select("query_id", "source_table", "target_table", "source_id", "target_id", "state")


@query(
    "lineage_summary",
    f"WITH e AS ({_EDGES_SQL}), n AS (SELECT stmt_id, source AS x FROM e UNION SELECT stmt_id, target FROM e), k AS (SELECT CAST(range AS BIGINT) AS stmt_id FROM range(1, 13)) SELECT k.stmt_id, (SELECT CAST(count(*) AS BIGINT) FROM n WHERE n.stmt_id = k.stmt_id) AS total_tables, (SELECT CAST(count(*) AS BIGINT) FROM e WHERE e.stmt_id = k.stmt_id) AS table_edges FROM k",
)
def lineage_summary(t):
    return _corpus(t).summary().select("stmt_id", "total_tables", "table_edges")


# graphs in the tables


def _places(t):
    """Region, nation, customer, order: a forest, all under one key."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda df, a, b: df.select(F.lit(0).alias("k"), a.alias("parent"), b.alias("child"))
    return (
        edge(t("nation"), name("r", "n_regionkey"), name("n", "n_nationkey"))
        .union(edge(t("customer"), name("n", "c_nationkey"), name("c", "c_custkey")))
        .union(edge(t("orders"), name("c", "o_custkey"), name("o", "o_orderkey")))
    )


_PLACES = "SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders"


@query("graph_closure_places", f"WITH RECURSIVE e AS ({_PLACES}), r AS (SELECT parent AS root, child AS node, 1 AS d FROM e UNION SELECT r.root, e.child, r.d + 1 FROM r JOIN e ON r.node = e.parent) SELECT root, node, CAST(min(d) AS BIGINT) AS depth FROM r GROUP BY ALL")
def graph_closure_places(t):
    return graph.closure(_places(t), "k", "parent", "child").select("root", "node", F.col("depth").cast("long").alias("depth"))


@query("graph_roots", f"WITH e AS ({_PLACES}) SELECT DISTINCT parent AS node FROM e WHERE parent NOT IN (SELECT child FROM e)")
def graph_roots(t):
    return graph.roots(_places(t), "k", "parent", "child").select("node")


@query("graph_leaves", f"WITH e AS ({_PLACES}) SELECT DISTINCT child AS node FROM e WHERE child NOT IN (SELECT parent FROM e)")
def graph_leaves(t):
    return graph.leaves(_places(t), "k", "parent", "child").select("node")


@query("graph_fanout", f"WITH e AS ({_PLACES}) SELECT parent AS node, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY parent")
def graph_fanout(t):
    return graph.fanout(_places(t), "k", "parent", "child").select("node", "n")


def _turns(t):
    c = t("conversations").select("conv_id", "turn").distinct()
    return c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"], "left_semi").select("conv_id", F.col("turn").alias("parent"), (F.col("turn") + 1).alias("child"))


@query("graph_depth_conversations", "WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS (SELECT a.conv_id, a.turn AS parent, a.turn + 1 AS child FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), r AS (SELECT conv_id, parent AS node, 0 AS d FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.conv_id = e.conv_id AND x.child = e.parent) UNION SELECT r.conv_id, e.child, r.d + 1 FROM r JOIN e ON r.conv_id = e.conv_id AND r.node = e.parent) SELECT conv_id, node, CAST(max(d) AS BIGINT) AS depth FROM r GROUP BY ALL")
def graph_depth_conversations(t):
    return graph.depths(_turns(t), "conv_id", "parent", "child").withColumn("depth", F.col("depth").cast("long"))


@query("graph_cycle_probe", "SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation")
def graph_cycle_probe(t):
    """A ring of all nations, and regions that lead into it but are not on it."""
    n = t("nation")
    ring = n.select(F.lit(0).alias("k"), F.col("n_nationkey").cast("long").alias("parent"), ((F.col("n_nationkey") + 1) % 25).cast("long").alias("child"))
    into = n.select(F.lit(0), (F.col("n_regionkey") + 1000).cast("long"), F.col("n_nationkey").cast("long"))
    return graph.cycles(ring.union(into), "k", "parent", "child").select("node")
