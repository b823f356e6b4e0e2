"""Provenance of single statements: what each construct must give."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.lineage import cli, combine, documents, render
from siltstone.lineage.api import LineageAnalyzer, LineageChainCombiner, LineageEventMapper, LineageVisualizer
from siltstone.lineage.dialects import DIALECTS, HAVE, STRICT, candidates
from siltstone.lineage.fallback import Scan, alias_of, function_of
from siltstone.lineage.naming import TableNames, base_name, naming_classes, split_column
from siltstone.lineage.parser import parse
from siltstone.lineage.providers import DictProvider, Registry, sample_registry
from siltstone.lineage.syntax import SqlSyntaxError
from siltstone.lineage.validation import dialect_error, path_error, sql_error

R = "QUERY_RESULT"
A = LineageAnalyzer()


def up(sql, **k):
    result = LineageAnalyzer(**k).analyze(sql)
    assert not result.errors, result.errors
    return {t: sorted(s) for t, s in result.table_lineage.upstream.items()}


def columns(sql):
    return {t: sorted(s) for t, s in A.analyze(sql).column_lineage.upstream.items()}


def test_select_and_join():
    assert up("SELECT id, name FROM users WHERE age > 21") == {R: ["users"]}
    sql = "SELECT u.name, o.total FROM users u JOIN orders o ON u.id = o.user_id"
    assert up(sql) == {R: ["orders", "users"]}
    assert columns(sql) == {f"{R}.name": ["users.name"], f"{R}.total": ["orders.total"]}
    assert A.analyze(sql).table_lineage.downstream == {"users": {R}, "orders": {R}}


def test_cte_stays_when_the_main_query_filters():
    sql = "WITH user_orders AS (SELECT u.name, COUNT(o.id) AS n FROM users u LEFT JOIN orders o ON u.id = o.user_id GROUP BY u.name) SELECT name, n FROM user_orders WHERE n > 5"
    assert up(sql) == {"user_orders": ["orders", "users"], R: ["user_orders"]}


def test_pass_through_cte_goes():
    sql = "WITH s AS (SELECT customer_id, SUM(t) AS x FROM orders GROUP BY customer_id), g AS (SELECT u.id, s.x FROM users u JOIN s ON u.id = s.customer_id), z AS (SELECT id, x FROM g) SELECT * FROM z ORDER BY x DESC"
    assert up(sql) == {"s": ["orders"], "g": ["s", "users"], R: ["g"]}


@pytest.mark.parametrize("kind", ["TABLE", "VIEW", "OR REPLACE VIEW", "TABLE IF NOT EXISTS"])
def test_created_target(kind):
    assert up(f"CREATE {kind} user_summary AS SELECT id, name FROM users") == {"user_summary": ["users"]}


def test_subqueries_count_as_sources():
    sql = "SELECT u.name, (SELECT COUNT(*) FROM orders o WHERE o.user_id = u.id) AS n FROM users u WHERE u.id IN (SELECT DISTINCT user_id FROM visits)"
    assert up(sql) == {R: ["orders", "users", "visits"]}
    kinds = {c["target_column"]: c["kind"] for c in A.row(sql)["column_edges"]}
    assert kinds == {"name": "DIRECT", "n": "SUBQUERY"}


def test_union_by_position():
    sql = "SELECT id, name, 'u' AS k FROM users UNION ALL SELECT product_id, product_name, 'p' FROM products UNION ALL SELECT category_id, category_name, 'c' FROM categories"
    assert up(sql) == {R: ["categories", "products", "users"]}
    assert columns(sql)[f"{R}.id"] == ["categories.category_id", "products.product_id", "users.id"]
    assert f"{R}.k" not in columns(sql)
    assert {c["source_column"] for c in A.row(sql)["column_edges"] if c["target_column"] == "k"} == {"LITERAL"}


def test_circle_of_ctes():
    result = A.analyze("WITH view_a AS (SELECT * FROM view_b), view_b AS (SELECT * FROM view_a) SELECT * FROM view_a")
    assert "CircularDependencyError" in result.errors[0] and "view_a -> view_b -> view_a" in result.errors[0]
    assert result.to_dict()["table_lineage"]["upstream"] == {}


def test_recursive_cte_may_name_itself():
    assert up("WITH RECURSIVE t AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t JOIN base ON base.n = t.n) SELECT n FROM t WHERE n < 9")["t"] == ["base", "t"]


@pytest.mark.parametrize("sql, word", [("", "empty"), ("   ", "empty"), ("-- only a comment", "parse"), ("SELECT FROM WHERE", "parse"), ("SELECT a, b WHERE a = 'x'", "parse"), ("x" * 1_000_001, "too long"), ("SELECT a FROM (SELECT b FROM t", "parse"), ("SELECT count( count( * FROM x", "parse"), ("INSERT INTO t PARTITION ( (1)", "parse")])
def test_errors(sql, word):
    result = A.analyze(sql)
    assert result.has_errors() and word in result.errors[0].lower()


def test_tolerated():
    assert not A.analyze("SELECT 1").errors
    two = A.analyze("SELECT a FROM t; SELECT b FROM u")
    assert not two.errors and two.table_lineage.upstream == {R: {"t"}} and two.has_warnings()


def test_dialects():
    assert A.analyze("SELECT TOP 100 * FROM users").dialect == "tsql"
    assert LineageAnalyzer("tsql").analyze("SELECT a FROM t LIMIT 5").dialect != "tsql"
    assert A.dialect == "trino"  # a corrected text changes nothing else
    assert candidates("SELECT TOP 5 a FROM t")[0] == "tsql"
    assert dialect_error("trino") is None and dialect_error("cobol") and dialect_error("")
    assert path_error("a<b") and path_error(" ") and path_error("a.sql") is None
    assert sql_error(5) and sql_error(None)


def test_statements_that_change_tables():
    assert up("INSERT INTO t (a) SELECT b FROM s") == {"t": ["s"]}
    assert columns("INSERT INTO t (a) SELECT b FROM s") == {"t.a": ["s.b"]}
    assert up("UPDATE t SET a = s.b FROM s WHERE s.id = t.id") == {"t": ["s"]}
    assert up("DELETE FROM t WHERE id IN (SELECT id FROM gone)") == {"t": ["gone"]}
    assert up("MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN UPDATE SET a = s.a WHEN NOT MATCHED THEN INSERT (id, a) VALUES (s.id, s.a)") == {"t": ["s"]}


def test_conditions_keep_their_sense():
    row = A.row("SELECT a FROM t WHERE a IS NOT NULL AND NOT (b = 1 OR c LIKE 'x%') AND d NOT IN (1, 2) AND e BETWEEN 1 AND 3")
    found = {(c["column"], c["operator"], c["value"]) for c in row["transformations"][0]["filter_conditions"]}
    assert found == {("t.a", "IS NOT NULL", None), ("t.b", "!=", "1"), ("t.c", "NOT LIKE", "'x%'"), ("t.d", "NOT IN", "(1, 2)"), ("t.e", "BETWEEN", "1 AND 3")}


def test_joins_keep_their_kinds():
    row = A.row("SELECT 1 AS one FROM a LEFT OUTER JOIN b ON a.i = b.i AND a.j > b.j CROSS JOIN c FULL JOIN d USING (k)")
    joins = row["transformations"][0]["joins"]
    assert [(j["join_type"], j["right_table"], len(j["conditions"])) for j in joins] == [("LEFT OUTER JOIN", "b", 2), ("CROSS JOIN", "c", 0), ("FULL JOIN", "d", 1)]


def test_joins_in_brackets():
    sql = "SELECT a.x, c.y FROM (a JOIN b ON a.i = b.i) LEFT JOIN (c CROSS JOIN (SELECT 1 AS z FROM d JOIN e ON d.q = e.q) f) ON a.i = c.i"
    assert up(sql) == {R: ["a", "b", "c", "d", "e"]}
    assert [j["right_table"] for j in A.row(sql)["transformations"][0]["joins"]] == ["b", "c", "derived_table_f"]


def test_windows_cases_and_aggregates():
    row = A.row("SELECT ROW_NUMBER() OVER (PARTITION BY r ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS rn, CASE WHEN s > 1 THEN 'a' WHEN s > 0 THEN 'b' ELSE 'c' END AS tier, COUNT(DISTINCT u) AS n, CAST(d AS DATE) AS day, a + b AS ab, UPPER(c) AS up FROM t GROUP BY 1")
    by = {c["target_column"]: c for c in row["column_edges"]}
    assert by["rn"]["window"] == {"function_name": "ROW_NUMBER", "partition_by": ["r"], "order_by": ["s DESC"], "frame": "ROWS UNBOUNDED PRECEDING"}
    assert by["tier"]["case"] == {"whens": [{"when": "s > 1", "then": "'a'"}, {"when": "s > 0", "then": "'b'"}], "else_value": "'c'"}
    assert by["n"]["aggregate"] == {"function_type": "COUNT", "column": "u", "distinct": True}
    assert [by[k]["kind"] for k in ("day", "ab", "up")] == ["CAST", "COMPUTED", "FUNCTION"]


def test_columns_of_a_derived_union_come_from_every_branch():
    sql = "SELECT d.x, d.y FROM (SELECT a AS x, c AS y FROM t1 UNION ALL SELECT b, x FROM t2 UNION SELECT 1, e + f FROM t3) d"
    got = columns(sql)
    assert got[f"{R}.x"] == ["t1.a", "t2.b"] and got[f"{R}.y"] == ["t1.c", "t2.x", "t3.e", "t3.f"]
    nested = "SELECT x FROM (SELECT x FROM (SELECT a AS x FROM t1 UNION ALL SELECT b FROM t2) i UNION ALL SELECT c FROM t3) o"
    assert columns(nested)[f"{R}.x"] == ["t1.a", "t2.b", "t3.c"]
    assert columns("SELECT d.x FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) d")[f"{R}.x"] == ["t1.x", "t2.x"]


def test_derived_tables_are_layers():
    sql = "CREATE TABLE x AS SELECT t1.c, t2.d FROM (SELECT a AS c FROM p) t1 FULL OUTER JOIN (SELECT * FROM q) t2 ON t1.c = t2.d"
    assert up(sql) == {"x": ["p", "q"]} and columns(sql)["x.c"] == ["p.a"]
    nodes = [(n["entity"], n["entity_type"], n["depth"]) for n in documents.walk(A.get_lineage_chain(sql)["chains"])]
    assert nodes == [("x", "table", 0), ("derived_table_t1", "derived_table", 1), ("p", "table", 2), ("derived_table_t2", "derived_table", 1), ("q", "table", 2)]


def test_names():
    names = TableNames("trino")
    names.register(["orders", "sales.orders", '"hive"."sales"."orders"', "part", "a.x", "b.x"])
    assert names.canonical("orders") == "hive.sales.orders" and names.spellings("orders") == sorted(["orders", "sales.orders", '"hive"."sales"."orders"'])
    assert names.canonical("a.x") == "a.x" and names.canonical("b.x") == "b.x"
    assert names.has_duplicates() and names.is_canonical("part") and names.summary()["tables"] == 4
    assert TableNames("trino", "disabled").canonical("t") == "t"
    assert split_column('"c"."s"."t"."col"') == ("c.s", "t", "col") and base_name("a.B") == "b"
    assert {k: len(v) for k, v in naming_classes(["a", "b.c", '"d"."e"."f"']).items()} == {"simple": 1, "schema": 1, "catalog": 1, "quoted": 1}
    assert up('SELECT o.a FROM "hive"."sales"."orders" o JOIN orders p ON o.a = p.a') == {R: ["hive.sales.orders"]}


def test_chain_arguments():
    for call in (lambda: A.get_table_lineage_chain("SELECT 1", "invalid", 1), lambda: A.get_column_lineage_chain("SELECT 1", "upstream", 0), lambda: A.get_lineage_chain("SELECT 1", "upstream", -1)):
        with pytest.raises(ValueError):
            call()


CHAIN = "WITH s AS (SELECT customer_id, SUM(t) AS x FROM orders WHERE ok = 1 GROUP BY customer_id), g AS (SELECT u.id, s.x FROM users u LEFT JOIN s ON u.id = s.customer_id) SELECT id, x FROM g WHERE x > 3 ORDER BY x"


def test_chains():
    tree = A.get_table_lineage_chain(CHAIN, "upstream", 2)["chains"][R]
    assert tree == {"table": R, "depth": 0, "dependencies": [{"table": "g", "depth": 1, "dependencies": [{"table": "users", "depth": 2, "dependencies": []}, {"table": "s", "depth": 2, "dependencies": []}]}]}
    column = A.get_column_lineage_chain(CHAIN, "upstream", 9)["chains"][f"{R}.x"]
    assert column["dependencies"][0]["dependencies"][0]["dependencies"][0]["column"] == "orders.t"
    doc = A.get_lineage_chain(CHAIN, "downstream")
    assert set(doc) == {"sql", "dialect", "chain_type", "max_depth", "actual_max_depth", "target_entity", "chains", "summary", "errors", "warnings"}
    assert set(doc["chains"]) == {"orders", "users"} and doc["actual_max_depth"] == 3 and doc["max_depth"] == "unlimited"
    assert set(doc["summary"]) == {"total_tables", "total_columns", "has_transformations", "has_metadata", "chain_count"} and doc["summary"]["total_tables"] == 5
    step = doc["chains"]["orders"]["dependencies"][0]["transformations"][0]
    assert step["filter_conditions"] == [{"column": "orders.ok", "operator": "=", "value": "1"}] and step["group_by_columns"] == ["customer_id"]
    assert A.get_lineage_chain(CHAIN, "upstream", 1)["actual_max_depth"] == 1
    assert list(A.get_lineage_chain(CHAIN, "downstream", 0, "s")["chains"]) == ["s"]
    assert documents.find_entity(doc["chains"], "g")["depth"] == 2 and documents.entities_at(doc["chains"], 0) == ["orders", "users"]
    cols = {c["name"]: c["type"] for c in documents.find_entity(doc["chains"], "s")["metadata"]["table_columns"]}
    assert cols == {"customer_id": "DIRECT", "x": "AGGREGATE"}
    assert json.loads(A.get_lineage_chain_json(CHAIN, "downstream")) == json.loads(json.dumps(doc))


PIPELINE = [
    "CREATE TABLE f AS SELECT * FROM orders",
    "CREATE TABLE s AS SELECT c, count(*) AS n FROM f GROUP BY c",
    "CREATE TABLE g AS SELECT c, n FROM s WHERE n > 1",
    "SELECT c FROM g",
    "SELECT a FROM lineitem",
    "SELECT s.c FROM s",
    "SELECT g.c, x.y FROM g JOIN x ON g.c = x.c",
]


def test_statements_are_chained():
    docs = [A.get_lineage_chain(q, "downstream") for q in PIPELINE]
    assert combine.chains(docs) == [[0, 1, 2, 3], [0, 1, 2, 6], [0, 1, 5], [4]]
    first = LineageChainCombiner.process_lineage_data_complete(docs)[0]
    assert first["chain_type"] == "combined_downstream" and first["actual_max_depth"] == 3 and first["target_entity"] == "combined_chain_1" and "-- query_2" in first["sql"]
    assert [(n["entity"], n["depth"]) for n in documents.walk(first["chains"])] == [("orders", 0), ("f", 1), ("s", 2), ("g", 3), (R, 4)]
    assert documents.find_entity(first["chains"], "f")["is_connection_point"]


def test_a_circle_of_statements_ends():
    docs = [A.get_lineage_chain(f"CREATE TABLE {a} AS SELECT id FROM {b}", "downstream") for a, b in (("a", "c"), ("b", "a"), ("c", "b"))]
    assert len(LineageChainCombiner.process_lineage_data_complete(docs)) == 1


def test_events():
    events = LineageEventMapper().map_lineage_chain_to_events(A.get_lineage_chain_json(CHAIN, "downstream"), tenant_id="t", association_type="MAP", association_id="m", query_id="q")
    assert {(e["source_table"], e["target_table"]) for e in events} == {("orders", "s"), ("s", "g"), ("users", "g"), ("g", R)}
    e = events[0]
    assert len(e) == 20 and e["source_type"] == "TABLE" and e["source_id"] == "table_orders" and e["state"] == "PERSISTENT" and len(e["timekey"]) == 8 and e["tenant_id"] == "t"


def test_metadata():
    a = LineageAnalyzer(registry=sample_registry())
    assert a.analyze("SELECT id FROM users").metadata["users"]["owner"] == "accounts"
    b = LineageAnalyzer()
    b.set_metadata_registry(Registry())
    b.add_metadata_provider(DictProvider({"s.users": {"description": "first"}}))
    b.add_metadata_provider(DictProvider({"users": {"description": "second"}}))
    assert b.analyze("SELECT id FROM s.users").metadata["s.users"]["description"] == "first"


def test_rendering(tmp_path):
    doc = A.get_lineage_chain(CHAIN, "downstream")
    dot = render.chain_dot(doc)
    assert dot.startswith("digraph") and "rankdir=LR" in dot and '"orders" -> "s"' in dot and 'label="WHERE (1)\\nGROUP BY (1)"' in dot
    assert "rankdir=BT" in render.chain_dot(A.get_lineage_chain(CHAIN, "upstream"), "vertical")
    v = LineageVisualizer()
    path = v.create_lineage_chain_diagram(json.dumps(doc), str(tmp_path / "x"))
    assert open(path).read() == dot and "svg" in v.get_supported_formats()
    assert '"users" -> "g"' in open(v.create_table_only_diagram(A.get_table_lineage_chain_json(CHAIN, "downstream", 3), str(tmp_path / "y"))).read()
    with pytest.raises(ValueError):
        render.chain_dot({"sql": ""})
    text = render.console(A.analyze(CHAIN).to_dict())
    assert "Table lineage" in text and "<- orders" in text
    assert "s <- orders" in render.compact(A.analyze(CHAIN).to_dict())


def test_command_line(tmp_path, capsys):
    assert cli.main(["analyze", "--sql", "SELECT a FROM t", "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["table_lineage"]["upstream"] == {R: ["t"]}
    assert cli.main(["analyze", "--sql", "SELECT FROM"]) == 1 and cli.main(["analyze"]) == 1 and cli.main(["analyze", "--sql", "SELECT 1", "--dialect", "x"]) == 1
    (tmp_path / "one.sql").write_text("CREATE TABLE x AS SELECT a FROM t")
    assert cli.main(["batch", str(tmp_path), "--output-dir", str(tmp_path / "out")]) == 0
    assert json.loads((tmp_path / "out/one_lineage.json").read_text())["table_lineage"]["upstream"] == {"x": ["t"]}
    assert "Failed to read file" in A.analyze_file(str(tmp_path / "none.sql")).errors[0]


def test_clauses():
    d = A.analyze_comprehensive("CREATE TABLE s.x WITH (format = 'ORC') AS SELECT DISTINCT a, count(*) AS n FROM t WHERE b = 1 GROUP BY a HAVING count(*) > 2 ORDER BY n DESC NULLS LAST LIMIT 5")
    assert d["success"] and d["sql_type"] == "CTAS" and d["target_table"] == "s.x" and d["table_properties"]["custom"]["format"] == "ORC"
    q = d["query"]
    assert q["distinct"] and q["limit"] == "5" and q["order_by"] == [{"column": "n", "direction": "DESC", "nulls": "LAST"}] and q["aggregations"][0]["function"] == "COUNT"
    assert A.analyze_comprehensive("INSERT INTO t (a, b) VALUES (1, 'x'), (2, 'y')")["values"] == [["1", "'x'"], ["2", "'y'"]]
    assert A.analyze_comprehensive("UPDATE t SET a = b + 1, c = (SELECT max(d) FROM u)")["update_type"] == "SUBQUERY"
    assert not A.analyze_comprehensive("nonsense")["success"]
    t = A.analyze_comprehensive("CREATE TABLE t (a INT PRIMARY KEY, b VARCHAR(10) NOT NULL DEFAULT 'x')")["column_definitions"]
    assert [(c["name"], c["data_type"], c["nullable"], c["primary_key"]) for c in t] == [("a", "INT", False, True), ("b", "VARCHAR(10)", False, False)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_parsed_or_refused(text):
    try:
        parse(text)
    except SqlSyntaxError:
        pass


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "t.b", "1", "'x'", "count(*)", "a + 1", "CASE WHEN a > 1 THEN b END"]), min_size=1, max_size=5), st.booleans())
def test_spans_give_the_text_back(items, where):
    sql = f"SELECT {', '.join(items)} FROM t" + (" WHERE a > 1" if where else "")
    s = parse(sql)
    assert [s.text(i.expr) for i in s.query.items] == items


TAKEN = [
    ("SELECT trim(both 'x' from c), trim(leading from d), trim(e) FROM t", {"t"}),
    ("SELECT a FROM t FOR VERSION AS OF 5 x JOIN u TIMESTAMP AS OF '2024-01-01' ON x.a = u.a", {"t", "u"}),
    ("SELECT a FROM t FOR SYSTEM_TIME AS OF now() AS x", {"t"}),
    ("SELECT row(1, 2).a, (SELECT s FROM u).f FROM t", {"t", "u"}),
    ("SELECT * FROM t PIVOT (sum(v) AS s, count(*) FOR m IN ('a' AS x, 'b')) AS p WHERE p.x > 1", {"t"}),
    ("SELECT * FROM t UNPIVOT (v FOR m IN (a, b)) u", {"t"}),
    ("SELECT * FROM t MATCH_RECOGNIZE (PARTITION BY a ORDER BY b MEASURES A.c AS c PATTERN (A B+) DEFINE B AS B.c > A.c) AS m", {"t"}),
    ("TABLE t", {"t"}),
    ("WITH x AS (TABLE t) SELECT a FROM x UNION TABLE u", None),
    ("SELECT t.a, u.b FROM t CROSS APPLY (SELECT b FROM v WHERE v.a = t.a) u OUTER APPLY f(t.c) w", {"t", "v"}),
    ("SELECT a FROM t START WITH p IS NULL CONNECT BY NOCYCLE PRIOR a = p ORDER BY a", {"t"}),
    ("SELECT t.a FROM t, u WHERE t.a = u.a(+) AND t.b(+) = 3", {"t", "u"}),
    ("SELECT a FROM t WHERE a ~* 'x' AND b !~ 'y' AND c ~ 'z'", {"t"}),
    ("SELECT j:x.y::int, a[1:2], a[i:k] FROM t", {"t"}),
    ("EXPLAIN ANALYZE SELECT a FROM t", {"t"}),
    ("EXPLAIN (FORMAT JSON) SELECT a FROM t", {"t"}),
    ("SELECT a FROM t WHERE b = 'x\\'' AND c = \"it's\"", None),
]


@pytest.mark.parametrize("sql, tables", TAKEN)
def test_constructs_of_all_dialects(sql, tables):
    got = LineageAnalyzer("spark" if "\\" in sql else "trino").analyze(sql)
    assert not got.errors
    if tables:
        assert got.table_lineage.upstream[R] == tables


@pytest.mark.parametrize("sql, kind", [("DROP TABLE IF EXISTS a.t CASCADE", "DROP"), ("TRUNCATE TABLE a.t", "TRUNCATE"), ("ALTER TABLE a.t ADD COLUMN x int", "ALTER"), ("ALTER TABLE a.t RENAME TO a.u", "ALTER")])
def test_statements_that_read_nothing(sql, kind):
    row = A.row(sql)
    assert row["errors"] == [] and row["sql_type"] == kind and row["target"] == "a.t" and row["table_edges"] == []


def test_long_and_deep_statements():
    many = A.row(" UNION ALL ".join(f"SELECT a FROM t{k}" for k in range(3000)))
    assert not many["errors"] and len(many["table_edges"]) == 3000 and len(many["column_edges"]) == 3000
    ands = A.row("SELECT a FROM t WHERE " + " AND ".join(f"c{k} = {k}" for k in range(20_000)))
    assert not ands["errors"] and len(ands["transformations"][0]["filter_conditions"]) == 20_000
    assert len(A.row("SELECT " + " + ".join(f"c{k}" for k in range(5000)) + " AS s FROM t")["column_edges"]) == 5000
    for text in ("(" * 900 + "a" + ")" * 900, "f(" * 3000 + "a" + ")" * 3000, "CASE WHEN a THEN " * 900 + "a" + " END" * 900, "NOT " * 5000 + "a"):
        row = A.row(f"SELECT {text} AS s FROM t")
        assert not row["errors"] and {e["source_column"] for e in row["column_edges"]} == {"a"}
    nested = A.row("SELECT a FROM (" * 400 + "SELECT a FROM t" + ") x" * 400)
    assert not nested["errors"] and ("t", "a") in {(e["source_entity"], e["source_column"]) for e in nested["column_edges"]}


def test_columns_of_functions_in_from():
    assert columns("SELECT x.a, y FROM t CROSS JOIN UNNEST(t.arr) AS x(a), UNNEST(t.brr) AS z(y)") == {f"{R}.a": ["t.arr"], f"{R}.y": ["t.brr"]}
    assert columns("SELECT e, b FROM t LATERAL VIEW explode(split(t.c, ',')) v AS e") == {f"{R}.e": ["t.c"], f"{R}.b": ["t.b"]}
    assert columns("SELECT u.b, g.n FROM t, LATERAL (SELECT v.b FROM v WHERE v.a = t.a) u, generate_series(1, 5) AS g(n)")[f"{R}.b"] == ["v.b"]
    assert "x" not in {e["name"] for e in A.row("SELECT x.a FROM t CROSS JOIN UNNEST(t.arr) AS x(a)")["entities"]}


def test_columns_without_a_name_and_by_elimination():
    assert columns("SELECT a + b, count(*) FROM t") == {f"{R}._col0": ["t.a", "t.b"]}
    assert [e["target_column"] for e in A.row("SELECT count(*), a FROM t")["column_edges"]] == ["_col0", "a"]
    assert columns("INSERT INTO w (p, q) SELECT upper(a), b FROM t") == {"w.p": ["t.a"], "w.q": ["t.b"]}
    assert columns("WITH c AS (SELECT k, v FROM t) SELECT v, z FROM c JOIN u ON c.k = u.k")[f"{R}.z"] == ["u.z"]


def test_dialects_by_their_constructs():
    assert set().union(*HAVE.values()) <= set(DIALECTS) and STRICT <= set(HAVE)
    for sql, given, found in [("SELECT j:x, a(+) FROM t", "trino", "snowflake"), ("SELECT a FROM t, u WHERE t.a = u.a(+) CONNECT BY PRIOR a = b", "trino", "oracle"), ("SELECT a::int FROM t", "trino", "trino"), ("SELECT TOP 3 a FROM t CROSS APPLY f(a) x", "postgres", "tsql")]:
        assert LineageAnalyzer(given).analyze(sql).dialect == found
    assert A.analyze("SELECT TOP 5 a FROM t CROSS APPLY f(a) x LIMIT 3").errors
    assert LineageAnalyzer("MSSQL").dialect == "tsql" and LineageAnalyzer("postgresql").dialect == "postgres"
    with pytest.raises(ValueError):
        LineageAnalyzer("cobol")
    assert up('SELECT "a" AS x FROM t # it\'s', dialect="mysql") == {R: ["t"]} and A.analyze('SELECT "a" AS x FROM t').column_lineage.upstream == {f"{R}.x": {"t.a"}}
    assert LineageAnalyzer("mysql").row('SELECT "a" AS x FROM t')["references"] == []


def test_a_name_is_as_full_as_all_agree():
    names = TableNames("postgres")
    names.register(["x", "a.s.x", "b.s.x", "y", "c.y", "Z", "k.z", "m.k.z"])
    assert [names.canonical(n) for n in ("x", "y", "z", "k.z")] == ["x", "c.y", "m.k.z", "m.k.z"]


def test_texts_that_do_not_parse_are_scanned():
    sql = "WITH c AS (SELECT a FROM s.t) SELECT x.a, count(*) n FROM c x LEFT OUTER JOIN u ON x.a = u.a AND u.b > 1 WHERE x.a BETWEEN 1 AND 2 AND u.c IS NOT NULL AND d IN (1, 2) GROUP BY x.a, f(b, c) HAVING count(*) > 1 ORDER BY a DESC !! ??("
    scan = Scan(sql)
    assert scan.tables == ["s.t", "u"] and scan.ctes == {"c": "SELECT a FROM s.t"} and scan.edges() == [(R, "s.t"), (R, "u")]
    assert scan.joins == [{"join_type": "LEFT OUTER JOIN", "right_table": "u", "condition": "x.a = u.a AND u.b > 1"}] and scan.aliases["x"] == "c"
    assert scan.listed("select") == ["x.a", "count(*) n"] and scan.listed("group_by") == ["x.a", "f(b, c)"] and alias_of("count(*) n") == "n" and function_of("count(*) n") == "COUNT"
    assert [(c["column"], c["operator"], c["value"]) for c in scan.conditions()] == [("x.a", "BETWEEN", "1 AND 2"), ("u.c", "IS NOT NULL", None), ("d", "IN", "(1, 2)")]
    row = A.row(sql)
    assert row["errors"] and [(e["target"], e["source"]) for e in row["table_edges"]] == scan.edges() and "scan" in row["warnings"][0]
    assert Scan("INSERT INTO w SELECT FROM 'x' JOIN t").edges() == [("w", "t")]
    assert A.row("SELECT FROM WHERE")["table_edges"] == []


def diamonds(n):
    """Each statement, and each CTE, reads the one before it on two ways."""
    ctes = ["c0 AS (SELECT k, v FROM t)"]
    for k in range(1, n):
        ctes += [f"l{k} AS (SELECT k, v FROM c{k - 1} WHERE v > {k})", f"r{k} AS (SELECT k, v FROM c{k - 1} WHERE v < {k})", f"c{k} AS (SELECT l{k}.k, r{k}.v FROM l{k} JOIN r{k} ON l{k}.k = r{k}.k)"]
    return f"WITH {', '.join(ctes)} SELECT k, v FROM c{n - 1} WHERE k > 0"


def test_documents_of_diamonds_stay_small():
    doc = A.get_lineage_chain(diamonds(40), "upstream")
    nodes = documents.walk(doc["chains"])
    assert len(nodes) < 3000 and doc["warnings"] == [documents.ONCE] and doc["summary"]["total_tables"] == 2 + 1 + 39 * 3
    small = A.get_lineage_chain(diamonds(4), "upstream")
    assert not small["warnings"] and not any(n.get("repeated") for n in documents.walk(small["chains"])) and sum(n["entity"] == "t" for n in documents.walk(small["chains"])) == 8
    simple = A.get_table_lineage_chain(diamonds(40), "upstream", 500)

    def size(n):
        return 1 + sum(map(size, n["dependencies"]))

    assert sum(map(size, simple["chains"].values())) < 4000 and documents.ONCE in simple["warnings"]


def test_chains_of_statements_stay_few():
    sqls = ["CREATE TABLE c0 AS SELECT k FROM t"]
    for k in range(1, 15):
        sqls += [f"CREATE TABLE l{k} AS SELECT k FROM c{k - 1}", f"CREATE TABLE r{k} AS SELECT k FROM c{k - 1}", f"CREATE TABLE c{k} AS SELECT l{k}.k FROM l{k} JOIN r{k} ON l{k}.k = r{k}.k"]
    docs = [A.get_lineage_chain(s, "downstream") for s in sqls]
    found = combine.chains(docs)
    assert len(found) == 1 and sorted(found[0]) == list(range(len(sqls)))
    assert all(found[0].index(k) < found[0].index(k + 1) for k in range(0, len(sqls) - 1, 3))
    assert len(combine.chains(docs[:7])) == 4
    assert len(json.dumps(combine.combined_documents(docs))) < 10_000_000


def test_detailed_diagrams():
    doc = A.get_lineage_chain("CREATE TABLE x AS SELECT u.name, sum(o.total) AS spent FROM users u JOIN orders o ON u.id = o.user_id WHERE o.state IN ('a', 'b') GROUP BY u.name HAVING count(*) > 1 ORDER BY u.name LIMIT 5", "upstream")
    dot = render.detailed_dot(doc)
    assert dot.startswith("digraph") and dot.count("<TABLE") == 3 and "sum(o.total)" in dot
    assert "JOIN orders ON users.id = orders.user_id" in dot and "WHERE orders.state IN ('a', 'b')" in dot and "GROUP BY u.name" in dot and "LIMIT 5" in dot
    assert '"x":name -> "step 0"' in dot and dot.count("style=dashed") == 2
    assert "<B>a&lt;b</B>" in render.detailed_dot(A.get_lineage_chain('SELECT k FROM "a<b"', "downstream"))


@pytest.mark.parametrize(
    "sql, action, made",
    [
        ("INSERT INTO w (k, v) SELECT a, b FROM s ON CONFLICT (k) DO UPDATE SET v = excluded.v + w.v, n = 1", {"action": "UPDATE", "columns": ["k"], "set": ["v = excluded.v + w.v", "n = 1"]}, {"w.k": ["s.a"], "w.v": ["s.b", "w.v"]}),
        ("INSERT INTO w (k, v) SELECT a, b FROM s ON CONFLICT DO NOTHING RETURNING k", {"action": "NOTHING", "columns": [], "set": []}, {"w.k": ["s.a"], "w.v": ["s.b"]}),
        ("INSERT INTO w (k, v) SELECT a, b FROM s ON DUPLICATE KEY UPDATE u = VALUES(v)", {"action": "UPDATE", "columns": [], "set": ["u = VALUES(v)"]}, {"w.k": ["s.a"], "w.v": ["s.b"], "w.u": ["s.b"]}),
    ],
)
def test_what_is_done_on_conflict(sql, action, made):
    assert A.analyze_comprehensive(sql)["conflict_action"] == action and columns(sql) == made
    odd = A.analyze_comprehensive("INSERT INTO w (k) VALUES (1) ON CONFLICT WITH SOMETHING ELSE")
    assert odd["success"] and odd["conflict_action"] is None and odd["on_conflict"] == "WITH SOMETHING ELSE"


def test_console_reports(capsys):
    doc = A.analyze("SELECT u.a FROM u JOIN o ON u.i = o.i WHERE o.b > 1 GROUP BY u.a").to_dict()
    plain = render.console(doc)
    assert "JOIN o ON u.i = o.i" in plain and "WHERE o.b > 1" in plain and "GROUP BY u.a" in plain and "\x1b" not in plain
    assert "\x1b[36m  QUERY_RESULT\x1b[0m" in render.console(doc, color=True)
    assert cli.main(["analyze", "--sql", "SELECT a FROM t", "--color"]) == 0 and "\x1b[32m    <- t" in capsys.readouterr().out
