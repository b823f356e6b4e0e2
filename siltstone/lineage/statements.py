"""What a statement is made of, clause by clause, as plain dictionaries."""

from __future__ import annotations

from .extract import AGGREGATES, Extractor, cte_levels, read_tables, scope_of
from .syntax import Expr, Query, Statement


def describe(s: Statement, dialect: str = "trino") -> dict:
    """The clauses of any supported statement."""
    x = Extractor(s, dialect)
    if s.query:
        for c in s.query.ctes:
            x.ctes.setdefault(c.name.lower(), c)
    out: dict = {"sql_type": s.kind}
    if s.target:
        out["target_table"] = s.target
    if s.kind in ("CTAS", "TABLE", "VIEW"):
        out |= {"table_properties": s.properties, "column_definitions": s.columns}
    if s.kind == "INSERT":
        out |= {"insert_type": "VALUES" if s.rows else "SELECT" if s.query else "DEFAULT", "insert_columns": s.column_names, "values": s.rows, "on_conflict": s.conflict, "conflict_action": (s.action or {}) | {"set": [f"{c} = {s.text(e)}" for c, e in s.assignments]} if s.action else None, "source_tables": read_tables(s.query) if s.query else []}
    if s.kind in ("UPDATE", "DELETE", "MERGE"):
        scope = scope_of(Query(0), None, [*s.sources, *(j.source for j in s.joins)])
        out |= {
            "set_clauses": [{"column": c, "value": s.text(e), "value_type": value_type(e), "source_columns": [".".join(a.parts) for a in e.walk() if a.kind == "column"]} for c, e in s.assignments],
            "from_tables": [t.name or t.alias for t in s.sources],
            "joins": [x._join(j, scope) for j in s.joins],
            "where_conditions": x.conditions(s.where, scope),
            "update_type": "JOIN" if s.joins else "FROM" if s.sources else "SUBQUERY" if any(e.query for _, a in s.assignments for e in a.walk()) else "SIMPLE",
        }
    if s.returning:
        out["returning"] = [s.text(i.expr) for i in s.returning]
    if s.query:
        out |= {"ctes": [cte(c, x) for c in s.query.ctes], "cte_order": [n for n, _ in cte_levels(s.query.ctes)], "recursive": s.query.recursive, "query": query(s.query, x)}
    return out


def value_type(e: Expr) -> str:
    kinds = {"literal": "LITERAL", "column": "COLUMN", "function": "FUNCTION", "case": "CASE", "cast": "CAST"}
    return "SUBQUERY" if any(a.query for a in e.walk()) else kinds.get(e.kind, "EXPRESSION")


def cte(c, x: Extractor) -> dict:
    return {"name": c.name, "columns": c.columns or [i.label for i in c.query.blocks()[0].items if i.label], "source_tables": read_tables(c.query), "sql": x.text(c.query), "query": query(c.query, x)}


def query(q: Query, x: Extractor) -> dict:
    """A query's clauses; of a set operation its branches."""
    tail = {"order_by": [{"column": x.text(e), "direction": d.split()[0], "nulls": d.split()[-1] if "NULLS" in d else None} for e, d in q.order], "limit": q.limit, "offset": q.offset}
    if q.operation:
        return {"operation": q.operation, "branches": [query(b, x) for b in q.blocks()], **tail}
    scope = scope_of(q)
    items = [item(i, x) for i in q.items]
    every = [e for i in q.items for e in i.expr.walk()]
    return {
        "select_columns": items,
        "distinct": q.distinct,
        "from_tables": [{"table": t.name or None, "alias": t.alias, "is_subquery": t.kind == "derived"} for t in q.sources],
        "joins": [x._join(j, scope) for j in q.joins],
        "where_conditions": x.conditions(q.where, scope),
        "group_by": [x.text(e) for e in q.group],
        "having_conditions": x.conditions(q.having, scope),
        "aggregations": [{"function": e.name, "column": x.text(e.args[0]) if e.args else None, "distinct": e.distinct} for e in every if e.kind == "function" and e.name in AGGREGATES and not e.window],
        "window_functions": [{"function": e.name, "partition_by": [x.text(p) for p in e.window.partition], "order_by": [f"{x.text(o)} {d}" for o, d in e.window.order], "frame": e.window.frame} for e in every if e.window],
        "case_statements": [x.text(e) for e in every if e.kind == "case"],
        "subqueries": [x.text(s) for s in q.subqueries()],
        **tail,
    }


def item(i, x: Extractor) -> dict:
    e = i.expr
    return {"expression": x.text(e), "alias": i.alias, "column_name": i.label, "source_table": ".".join(e.parts[:-1]) or None if e.kind == "column" else None, "is_star": e.kind == "star", "value_type": value_type(e)}
