"""Provenance queries over statements that are made by rules, several hundred of them.

What each statement must give is known from the rule that made it; the SQL
computes it from the rule's number, so nothing is read off the statements.
"""

from __future__ import annotations

import pyspark.sql.functions as F

from siltstone.lineage import combine, graph
from siltstone.lineage.corpus import Corpus, chain_nodes, clauses, parse_statements
from siltstone.lineage.naming import canonical_names
from siltstone.operators.base import Family

family = Family()
query = family.query

#: Statements of each rule.
EACH = 50
R = "QUERY_RESULT"
#: By rule: the text, kind, edges between tables and columns, columns that are read, and nodes of the upstream chain (entity, depth); ``#`` is the number.
RULES: list[tuple[str, str, str, str, str, str]] = [
    ("SELECT a.c# AS x, b.d AS y FROM t# a JOIN u# b ON a.id = b.id WHERE a.s > #", "SELECT", f"{R}<t# {R}<u#", f"{R}.x<t#.c# {R}.y<u#.d", "t#.c# t#.id t#.s u#.d u#.id", f"{R}:0 t#:1 u#:1"),
    ("CREATE TABLE w# AS SELECT g, sum(v#) AS total FROM s.f# GROUP BY g", "CTAS", "w#<s.f#", "w#.g<s.f#.g w#.total<s.f#.v#", "s.f#.g s.f#.v#", "w#:0 s.f#:1"),
    ("INSERT INTO w# (p, q) SELECT upper(m), n + # FROM src#", "INSERT", "w#<src#", "w#.p<src#.m w#.q<src#.n", "src#.m src#.n", "w#:0 src#:1"),
    ("UPDATE z# SET a = s.b, c = z#.c + 1 FROM s# s WHERE z#.id = s.id", "UPDATE", "z#<s#", "z#.a<s#.b z#.c<z#.c", "", "z#:0 s#:1"),
    (
        "WITH c1 AS (SELECT k, v FROM r#), c2 AS (SELECT k, max(v) AS m FROM c1 GROUP BY k) SELECT c2.m AS top, e.n FROM c2 JOIN e# e ON c2.k = e.k",
        "CTE", f"c1<r# c2<c1 {R}<c2 {R}<e#", f"c1.k<r#.k c1.v<r#.v c2.k<c1.k c2.m<c1.v {R}.top<c2.m {R}.n<e#.n", "r#.k r#.v c1.k c1.v c2.m c2.k e#.n e#.k", f"{R}:0 c2:1 c1:2 r#:3 e#:1",
    ),
    ("SELECT d.x FROM (SELECT a AS x FROM l# UNION ALL SELECT b FROM m#) d", "SELECT", f"{R}<l# {R}<m#", f"{R}.x<l#.a {R}.x<m#.b", "l#.a m#.b", f"{R}:0 derived_table_d:1 l#:2 m#:2"),
    ("MERGE INTO y# t USING x# s ON t.id = s.id WHEN MATCHED THEN UPDATE SET v = s.w WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.w)", "MERGE", "y#<x#", "y#.v<x#.w y#.id<x#.id", "", "y#:0 x#:1"),
    ("SELECT e, t.b FROM t# t LATERAL VIEW explode(t.arr#) v AS e", "SELECT", f"{R}<t#", f"{R}.e<t#.arr# {R}.b<t#.b", "t#.arr# t#.b", f"{R}:0 t#:1"),
    ("SELECT id, row_number() OVER (PARTITION BY g ORDER BY ts) AS rn FROM ev#", "SELECT", f"{R}<ev#", f"{R}.id<ev#.id {R}.rn<ev#.g {R}.rn<ev#.ts", "ev#.id ev#.g ev#.ts", f"{R}:0 ev#:1"),
    ("SELECT a FROM p# WHERE b IN (SELECT c FROM q#) ORDER BY a LIMIT #", "SELECT", f"{R}<p# {R}<q#", f"{R}.a<p#.a", "p#.a p#.b q#.c", f"{R}:0 p#:1 q#:1"),
]


def _statements(t):
    rows = [(k * len(RULES) + i, rule[0].replace("#", str(k))) for k in range(EACH) for i, rule in enumerate(RULES)]
    return t.spark.createDataFrame(rows, "stmt_id long, sql string").repartition(4)


def _corpus(t) -> Corpus:
    return Corpus(parse_statements(_statements(t)))


def _sql(which: int, split: str, names: str, casts: str = "") -> str:
    """Rows of all rules: the statement's id, and the parts of each entry between the signs of ``split``."""
    out = []
    for i, rule in enumerate(RULES):
        for entry in rule[which].split():
            if split == ".":
                parts = list(entry.rpartition(".")[::2])
            else:
                parts = entry.split(split) if split else [entry]
            values = ", ".join("replace('" + p + "', '#', CAST(k AS VARCHAR))" for p in parts)
            out.append(f"SELECT k * {len(RULES)} + {i}, {values} FROM range({EACH}) r(k)")
    return f"SELECT * {casts} FROM ({' UNION ALL '.join(out)}) e(stmt_id, {names})"


@query("lineage_generated_kinds", _sql(1, "", "sql_type"))
def lineage_generated_kinds(t):
    return _corpus(t).statements().where(F.size("errors") == 0).select("stmt_id", "sql_type")


@query("lineage_generated_table_edges", _sql(2, "<", "target, source"))
def lineage_generated_table_edges(t):
    return _corpus(t).table_edges()


def _columns(t):
    c = _corpus(t).column_edges().where("not startswith(target_entity, 'derived_table') and source_column is not null")
    return c.select("stmt_id", F.concat_ws(".", "target_entity", "target_column").alias("target"), F.concat_ws(".", "source_entity", "source_column").alias("source")).distinct()


@query("lineage_generated_column_edges", _sql(3, "<", "target, source"))
def lineage_generated_column_edges(t):
    return _columns(t)


@query("lineage_generated_references", _sql(4, ".", 'table_name, "column"'))
def lineage_generated_references(t):
    return _corpus(t).references().select("stmt_id", F.col("table").alias("table_name"), "column")


@query("lineage_generated_chain_nodes", _sql(5, ":", "entity, depth", "REPLACE (CAST(depth AS BIGINT) AS depth)"))
def lineage_generated_chain_nodes(t):
    """The nodes of every statement's upstream document."""
    return chain_nodes(_statements(t)).select("stmt_id", "entity", "depth")


_EDGES = _sql(3, "<", "target, source")


@query(
    "lineage_column_closure",
    f"WITH RECURSIVE e AS ({_EDGES}), reach AS (SELECT stmt_id, target AS root, source AS node FROM e UNION SELECT r.stmt_id, r.root, e.source FROM reach r JOIN e ON e.stmt_id = r.stmt_id AND e.target = r.node) SELECT stmt_id, root, node FROM reach",
)
def lineage_column_closure(t):
    """All that each column comes from, through common table expressions."""
    return graph.closure(_columns(t), "stmt_id", "target", "source").select("stmt_id", "root", "node")


@query(
    "lineage_column_closure_across_statements",
    # Rule 1 makes w# and rule 2 adds to it, so a column of w# that a later statement reads comes from both.
    "SELECT * FROM (SELECT 'w' || k || '.' || c AS root, s AS node FROM (SELECT k, unnest(['g', 'total', 'p', 'q']) AS c, unnest(['s.f' || k || '.g', 's.f' || k || '.v' || k, 'src' || k || '.m', 'src' || k || '.n']) AS s FROM range(50) r(k)))",
)
def lineage_column_closure_across_statements(t):
    """The same over the whole corpus as one graph, for the tables that its statements make."""
    edges = _columns(t).where(~F.startswith("target", F.lit(R)) & ~F.startswith("source", F.lit("c1.")) & ~F.startswith("source", F.lit("c2."))).withColumn("all", F.lit(0)).drop("stmt_id").distinct()
    return graph.closure(edges, "all", "target", "source").where(F.col("root").rlike(r"^w\d+\.")).select("root", "node")


@query(
    "lineage_generated_clauses",
    "SELECT k * 10 + i AS stmt_id, clause, replace(txt, '#', CAST(k AS VARCHAR)) AS text FROM range(50) r(k), (VALUES (0, 'select', 'a.c#'), (0, 'select', 'b.d'), (0, 'from', 't#'), (0, 'join', 'JOIN u#'), (0, 'where', 't#.s > #'), (1, 'select', 'g'), (1, 'select', 'sum(v#)'), (1, 'from', 's.f#'), (1, 'group_by', 'g'), (3, 'set', 'a = s.b'), (3, 'set', 'c = z#.c + 1'), (3, 'from', 's#'), (3, 'where', 's#.id = z#.id'), (9, 'select', 'a'), (9, 'from', 'p#'), (9, 'where', 'p#.b IN SELECT c FROM q#'), (9, 'order_by', 'a ASC'), (9, 'limit', '#')) v(i, clause, txt)",
)
def lineage_generated_clauses(t):
    """Clause by clause, for the rules of a join, a created table, an update and a subquery."""
    # The update's condition is told from the source's side here, as its own table comes last.
    wanted = [i for i in range(len(RULES)) if i in (0, 1, 3, 9)]
    rows = [(k * len(RULES) + i, RULES[i][0].replace("#", str(k)).replace(f"z{k}.id = s.id", f"s.id = z{k}.id")) for k in range(EACH) for i in wanted]
    return clauses(t.spark.createDataFrame(rows, "stmt_id long, sql string")).select("stmt_id", "clause", "text")


def _count(text: str) -> int:
    return len(set(text.split()))


_SUMMARY = ", ".join(
    f"({i}, '{kind}', {len({x for e in edges.split() for x in e.split('<')})}, {len({r.rpartition('.')[2] for r in references.split()})}, {_count(edges)})" for i, (_, kind, edges, _, references, _) in enumerate(RULES)
)


@query("lineage_generated_summary", f"SELECT k * {len(RULES)} + i AS stmt_id, kind AS sql_type, CAST(tables AS BIGINT) AS total_tables, CAST(cols AS BIGINT) AS total_columns, CAST(edges AS BIGINT) AS table_edges FROM range({EACH}) r(k), (VALUES {_SUMMARY}) v(i, kind, tables, cols, edges)")
def lineage_generated_summary(t):
    return _corpus(t).summary().select("stmt_id", "sql_type", "total_tables", "total_columns", "table_edges")


_TABLE_EDGES = _sql(2, "<", "target, source")


@query(
    "lineage_generated_table_closure",
    f"WITH RECURSIVE e AS ({_TABLE_EDGES}), reach AS (SELECT stmt_id, target AS root, source AS node, CAST(1 AS INTEGER) AS depth FROM e UNION SELECT r.stmt_id, r.root, e.source, r.depth + 1 FROM reach r JOIN e ON e.stmt_id = r.stmt_id AND e.target = r.node) SELECT stmt_id, root, node, min(depth) AS depth FROM reach GROUP BY 1, 2, 3",
)
def lineage_generated_table_closure(t):
    """Every table that a table or common table expression comes from, and how many steps away."""
    return graph.closure(_corpus(t).table_edges(), "stmt_id", "target", "source")


@query(
    "lineage_generated_producers",
    # Of the two rules that write w# the later statement counts.
    f"SELECT prefix || k AS table_name, k * {len(RULES)} + i AS stmt_id FROM range({EACH}) r(k), (VALUES ('w', 2), ('z', 3), ('y', 6)) v(prefix, i)",
)
def lineage_generated_producers(t):
    c = _corpus(t)
    return combine.producers(c.table_edges(), c.statements())


_READ = [(i, e.partition("<")[2]) for i, rule in enumerate(RULES) for e in rule[2].split() if e.partition("<")[2] not in ("c1", "c2")]


@query("lineage_generated_consumers", " UNION ALL ".join(f"SELECT replace('{name}', '#', CAST(k AS VARCHAR)) AS table_name, k * {len(RULES)} + {i} AS stmt_id FROM range({EACH}) r(k)" for i, name in _READ))
def lineage_generated_consumers(t):
    c = _corpus(t)
    return combine.consumers(c.table_edges(), c.statements(), c.entities())


#: Texts and the dialect that their constructs speak for, begun as Trino.
SPOKEN = [("SELECT TOP # a FROM t#", "tsql"), ("SELECT a FROM t# LIMIT #", "trino"), ("SELECT a FROM t#, u# WHERE t#.i = u#.i(+) CONNECT BY PRIOR a = b", "oracle"), ("SELECT j:x, a(+) FROM t#", "snowflake"), ("SELECT a::int FROM t#", "trino"), ("SELECT TOP # a FROM t# CROSS APPLY f(t#.a) x", "tsql")]


@query("lineage_generated_dialects", f"SELECT k * {len(SPOKEN)} + i AS stmt_id, d AS dialect FROM range({EACH}) r(k), (VALUES {', '.join(f'({i}, {chr(39)}{d}{chr(39)})' for i, (_, d) in enumerate(SPOKEN))}) v(i, d)")
def lineage_generated_dialects(t):
    """The dialect that each text is taken to be in."""
    rows = [(k * len(SPOKEN) + i, text.replace("#", str(k))) for k in range(EACH) for i, (text, _) in enumerate(SPOKEN)]
    parsed = Corpus(parse_statements(t.spark.createDataFrame(rows, "stmt_id long, sql string").repartition(4))).statements()
    return parsed.where(F.size("errors") == 0).select("stmt_id", "dialect")


#: Texts that no parser takes, and the edges that a scan of their words finds.
BROKEN = [("SELECT a FROM t# JOIN u# ON t#.i = u#.i WHERE ((", f"{R}<t# {R}<u#"), ("INSERT INTO w# SELECT FROM 'x' JOIN s.t#", "w#<s.t#"), ("WITH c AS (SELECT a FROM r#) SELECT FROM c LEFT JOIN v#", f"{R}<r# {R}<v#"), ("CREATE TABLE n# AS SELECT ?? FROM m# !! ", "n#<m#")]


@query(
    "lineage_generated_scans",
    " UNION ALL ".join(f"SELECT k * {len(BROKEN)} + {i} AS stmt_id, replace('{e.partition('<')[0]}', '#', CAST(k AS VARCHAR)) AS target, replace('{e.partition('<')[2]}', '#', CAST(k AS VARCHAR)) AS source, CAST(1 AS BIGINT) AS errors FROM range({EACH}) r(k)" for i, (_, edges) in enumerate(BROKEN) for e in edges.split()),
)
def lineage_generated_scans(t):
    rows = [(k * len(BROKEN) + i, text.replace("#", str(k))) for k in range(EACH) for i, (text, _) in enumerate(BROKEN)]
    c = Corpus(parse_statements(t.spark.createDataFrame(rows, "stmt_id long, sql string").repartition(4)))
    failed = c.statements().select("stmt_id", F.size("errors").cast("long").alias("errors"))
    return c.table_edges().join(failed, "stmt_id")


@query(
    "lineage_generated_canonical_names",
    f"SELECT k, replace(name, '#', CAST(k AS VARCHAR)) AS name, replace(canonical, '#', CAST(k AS VARCHAR)) AS canonical FROM range({EACH}) r(k), (VALUES ('t#', 'c.s.t#'), ('s.t#', 'c.s.t#'), ('\"c\".\"s\".\"t#\"', 'c.s.t#'), ('u#', 'u#'), ('a.u#', 'a.u#'), ('b.u#', 'b.u#'), ('v#', 'v#'), ('x.s.v#', 'x.s.v#'), ('y.s.v#', 'y.s.v#'), ('W#', 'd.w#'), ('d.w#', 'd.w#')) v(name, canonical)",
)
def lineage_generated_canonical_names(t):
    """A name is as qualified as all spellings that end in it agree on."""
    names = ["t#", "s.t#", '"c"."s"."t#"', "u#", "a.u#", "b.u#", "v#", "x.s.v#", "y.s.v#", "W#", "d.w#"]
    return canonical_names(t.spark.createDataFrame([(k, n.replace("#", str(k))) for k in range(EACH) for n in names], "k long, name string"), "k")
