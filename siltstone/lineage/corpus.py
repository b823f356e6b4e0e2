"""Provenance of a table of statements.

Statements are parsed on the executors, each once, in Arrow batches; what comes
back is one row a statement with nested edges.  Edges, transformations and
references are then plain relations, exploded from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema

from siltstone.sources.session import ship

from . import documents
from .dialects import parse_any
from .extract import CircularDependencyError, extract
from .fallback import Scan
from .naming import QUERY_RESULT, clean
from .parser import MOST_LEVELS, deep
from .statements import describe
from .syntax import SqlSyntaxError
from .validation import checked_dialect, sql_error

_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())
_CONDITION = pa.struct([("column", _TEXT), ("operator", _TEXT), ("value", _TEXT), ("values", _TEXTS), ("owner", _TEXT)])
_JOIN = pa.struct([("join_type", _TEXT), ("right_table", _TEXT), ("conditions", pa.list_(pa.struct([("left_column", _TEXT), ("operator", _TEXT), ("right_column", _TEXT)])))])
COLUMN_EDGE = pa.struct(
    [
        ("target_entity", _TEXT), ("target_column", _TEXT), ("source_entity", _TEXT), ("source_column", _TEXT), ("ordinal", pa.int32()), ("branch", pa.int32()), ("kind", _TEXT), ("function_type", _TEXT), ("expression", _TEXT),
        ("aggregate", pa.struct([("function_type", _TEXT), ("column", _TEXT), ("distinct", pa.bool_())])),
        ("window", pa.struct([("function_name", _TEXT), ("partition_by", _TEXTS), ("order_by", _TEXTS), ("frame", _TEXT)])),
        ("case", pa.struct([("whens", pa.list_(pa.struct([("when", _TEXT), ("then", _TEXT)]))), ("else_value", _TEXT)])),
    ]
)
TRANSFORMATION = pa.struct(
    [
        ("source_table", _TEXT), ("target_table", _TEXT), ("transformation_type", _TEXT), ("join_type", _TEXT), ("joins", pa.list_(_JOIN)), ("filter_conditions", pa.list_(_CONDITION)), ("group_by_columns", _TEXTS),
        ("having_conditions", pa.list_(_CONDITION)), ("order_by_columns", _TEXTS), ("union_type", _TEXT), ("distinct", pa.bool_()), ("limiting", pa.struct([("limit", _TEXT), ("offset", _TEXT)])),
    ]
)
PARSED = pa.schema(
    [
        ("stmt_id", pa.int64()), ("sql", _TEXT), ("dialect", _TEXT), ("sql_type", _TEXT), ("target", _TEXT),
        ("entities", pa.list_(pa.struct([("name", _TEXT), ("type", _TEXT)]))),
        ("table_edges", pa.list_(pa.struct([("target", _TEXT), ("source", _TEXT)]))),
        ("column_edges", pa.list_(COLUMN_EDGE)),
        ("transformations", pa.list_(TRANSFORMATION)),
        ("references", pa.list_(pa.struct([("table", _TEXT), ("column", _TEXT)]))),
        ("cte_order", pa.list_(pa.struct([("name", _TEXT), ("level", pa.int32())]))),
        ("eliminated", _TEXTS), ("errors", _TEXTS), ("warnings", _TEXTS),
    ]
)


def parsed_row(stmt_id: int | None, sql: str | None, dialect: str = "trino", mode: str = "full") -> dict:
    """The row of one statement; what is wrong with it goes into ``errors``."""
    row = {f.name: [] if pa.types.is_list(f.type) else None for f in PARSED} | {"stmt_id": stmt_id, "sql": sql, "dialect": dialect}
    if why := sql_error(sql):
        return row | {"errors": [why]}
    try:
        statement, used = parse_any(sql, dialect)
        found = extract(statement, used, mode)
    except CircularDependencyError as e:
        return row | {"errors": [str(e)]}
    except (SqlSyntaxError, RecursionError) as e:
        scan = Scan(sql, dialect)
        edges = [{"target": t, "source": s} for t, s in scan.edges()]
        names = dict.fromkeys(x for t in edges for x in (t["target"], t["source"]))
        entities = [{"name": n, "type": "query_result" if n == QUERY_RESULT else "table"} for n in names]
        return row | {"errors": [f"Failed to parse SQL: {e}"], "target": scan.target if edges else None, "table_edges": edges, "entities": entities, "warnings": ["tables were found by a scan of the words"] if edges else []}
    warnings = list(dict.fromkeys(found.warnings)) + ([f"dialect {dialect} was corrected to {used}"] if used != dialect else []) + (["only the first statement was analysed"] if statement.tail else [])
    return row | {
        "dialect": used,
        "sql_type": statement.kind,
        "target": statement.target,
        "entities": [{"name": n, "type": t} for n, t in found.entities.items()],
        "table_edges": [{"target": t, "source": s} for t, s in found.table_edges],
        "column_edges": found.column_edges,
        "transformations": found.transformations,
        "references": [{"table": t, "column": c} for t, c in found.references],
        "cte_order": [{"name": n, "level": k} for n, k in found.cte_order],
        "eliminated": found.eliminated,
        "warnings": warnings,
    }


def parse_statements(statements: DataFrame, dialect: str = "trino", mode: str = "full", id_col: str = "stmt_id", sql_col: str = "sql") -> DataFrame:
    """A row of schema PARSED for each statement, made on the executors."""

    ship(statements.sparkSession)
    dialect = checked_dialect(dialect)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parsed_row(i, s, dialect, mode) for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=PARSED)

    return statements.select(F.col(id_col).cast("long"), F.col(sql_col).cast("string")).mapInArrow(run, from_arrow_schema(PARSED))


def _each(statements: DataFrame, dialect: str, id_col: str, sql_col: str, kinds: pa.Schema, rows_of) -> DataFrame:
    """The rows that ``rows_of(sql, dialect)`` gives for each statement, with its id; a text that can't be parsed has none."""
    ship(statements.sparkSession)
    dialect = checked_dialect(dialect)
    names = kinds.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, sql in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(i, *r) for r in rows_of(sql, dialect)]
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return statements.select(F.col(id_col).cast("long"), F.col(sql_col).cast("string")).mapInArrow(run, from_arrow_schema(kinds))


def chain_nodes(statements: DataFrame, chain_type: str = "upstream", dialect: str = "trino", id_col: str = "stmt_id", sql_col: str = "sql") -> DataFrame:
    """stmt_id, entity, entity_type, depth, parent: the nodes of each statement's chain document, made on the executors."""
    kinds = pa.schema([("stmt_id", pa.int64()), ("entity", _TEXT), ("entity_type", _TEXT), ("depth", pa.int64()), ("parent", _TEXT)])

    def rows_of(sql: str | None, dialect: str) -> Iterator[tuple]:
        row = parsed_row(0, sql, dialect)
        if row["errors"]:
            return
        left = [(n, None) for n in reversed(documents.lineage_chain(row, chain_type)["chains"].values())]
        while left:
            n, parent = left.pop()
            yield n["entity"], n["entity_type"], n["depth"], parent
            left += [(d, n["entity"]) for d in reversed(n["dependencies"])]

    return _each(statements, dialect, id_col, sql_col, kinds, rows_of)


def clauses(statements: DataFrame, dialect: str = "trino", id_col: str = "stmt_id", sql_col: str = "sql") -> DataFrame:
    """stmt_id, clause, ordinal, text: each entry of the outermost clauses (of a set operation, of its first branch)."""
    kinds = pa.schema([("stmt_id", pa.int64()), ("clause", _TEXT), ("ordinal", pa.int64()), ("text", _TEXT)])

    def condition(c: dict) -> str:
        return " ".join(x for x in (c["column"], c["operator"], c["value"]) if x)

    def rows_of(sql: str | None, dialect: str) -> Iterator[tuple]:
        if sql_error(sql):
            return
        try:
            statement, used = parse_any(sql, dialect)
            with deep(MOST_LEVELS):
                told = describe(statement, used)
        except (SqlSyntaxError, RecursionError):
            return
        q = told.get("query") or {}
        tail = {k: q.get(k) for k in ("order_by", "limit", "offset")}
        q = (q["branches"][0] if "branches" in q else q) | {k: v for k, v in tail.items() if v}
        parts = {
            "cte": [c["name"] for c in told.get("ctes", [])],
            "select": [c["expression"] for c in q.get("select_columns", [])],
            "set": [f"{c['column']} = {c['value']}" for c in told.get("set_clauses", [])],
            "from": [x["table"] or x["alias"] for x in q.get("from_tables", [])] or told.get("from_tables", []),
            "join": [f"{j['join_type']} {j['right_table']}" for j in q.get("joins", []) or told.get("joins", [])],
            "where": [condition(c) for c in q.get("where_conditions", []) or told.get("where_conditions", [])],
            "group_by": q.get("group_by", []),
            "having": [condition(c) for c in q.get("having_conditions", [])],
            "order_by": [f"{o['column']} {o['direction']}" for o in q.get("order_by", [])],
            "limit": [q["limit"]] if q.get("limit") else [],
            "offset": [q["offset"]] if q.get("offset") else [],
            "returning": told.get("returning", []),
        }
        for clause, texts in parts.items():
            for k, text in enumerate(texts):
                yield clause, k, text

    return _each(statements, dialect, id_col, sql_col, kinds, rows_of)


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """stmt_id, sql, path: one statement a file, of a file, a folder or a glob."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("sql"), F.input_file_name().alias("path"))
    return files.select(F.xxhash64("path").alias("stmt_id"), "sql", "path")


class Corpus:
    """Relations over parsed statements."""

    def __init__(self, parsed: DataFrame):
        self.parsed = parsed

    def _exploded(self, what: str) -> DataFrame:
        return self.parsed.select("stmt_id", F.inline(what))

    def statements(self) -> DataFrame:
        return self.parsed.select("stmt_id", "sql_type", "dialect", "target", "errors", "warnings", "sql")

    def entities(self) -> DataFrame:
        return self._exploded("entities")

    def table_edges(self) -> DataFrame:
        return self._exploded("table_edges")

    def column_edges(self) -> DataFrame:
        return self._exploded("column_edges")

    def transformations(self) -> DataFrame:
        return self._exploded("transformations")

    def references(self) -> DataFrame:
        return self._exploded("references")

    def cte_order(self) -> DataFrame:
        return self._exploded("cte_order")

    def joins(self) -> DataFrame:
        """Each join once: stmt_id, target_table, join_type, right_table, left_column, operator, right_column."""
        j = self.transformations().select("stmt_id", "target_table", F.explode("joins").alias("j")).select("stmt_id", "target_table", "j.*").distinct()
        return j.select("stmt_id", "target_table", "join_type", "right_table", F.explode_outer("conditions").alias("c")).select("stmt_id", "target_table", "join_type", "right_table", "c.*")

    def filters(self, which: str = "filter_conditions") -> DataFrame:
        """Each condition once: stmt_id, target_table, column, operator, value."""
        c = self.transformations().select("stmt_id", "target_table", F.explode(which).alias("c"))
        return c.select("stmt_id", "target_table", "c.column", "c.operator", "c.value", "c.owner").distinct()

    def names(self) -> DataFrame:
        """stmt_id, name of every table, as canonical names have them."""
        e = self.table_edges()
        return e.select("stmt_id", F.col("source").alias("name")).union(e.select("stmt_id", "target")).distinct().select("stmt_id", clean(F.col("name")).alias("name"))

    def summary(self) -> DataFrame:
        """Counts by statement: tables, columns, edges, transformations, errors."""
        size = lambda c: F.size(c).cast("long")
        tables = F.array_distinct(F.flatten(F.array(F.transform("table_edges", lambda e: e["target"]), F.transform("table_edges", lambda e: e["source"]))))
        columns = F.array_distinct(F.transform("references", lambda r: r["column"]))
        return self.parsed.select("stmt_id", "sql_type", size(tables).alias("total_tables"), size(columns).alias("total_columns"), size("table_edges").alias("table_edges"), size("column_edges").alias("column_edges"), (F.size("transformations") > 0).alias("has_transformations"), size("errors").alias("errors"))
