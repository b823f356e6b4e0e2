"""The analyzer: one statement at a time, or a whole table of them."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import combine, documents, events, render, statements
from .corpus import Corpus, parse_statements, parsed_row
from .dialects import parse_any
from .logs import timed
from .providers import MetadataProvider, Registry
from .syntax import SqlSyntaxError
from .validation import chain_error, checked_dialect, path_error, sql_error

log = logging.getLogger("siltstone.lineage")


@dataclass
class Side:
    """A lineage graph in both directions, with what is done on it."""

    upstream: dict[str, set[str]] = field(default_factory=dict)
    downstream: dict[str, set[str]] = field(default_factory=dict)
    transformations: dict[str, list[dict]] = field(default_factory=dict)


@dataclass
class LineageResult:
    sql: str
    dialect: str
    table_lineage: Side
    column_lineage: Side
    metadata: dict[str, dict | None]
    errors: list[str]
    warnings: list[str]
    document: dict = field(repr=False, default_factory=dict)

    def has_errors(self) -> bool:
        return bool(self.errors)

    def has_warnings(self) -> bool:
        return bool(self.warnings)

    def to_dict(self) -> dict:
        return self.document


class LineageAnalyzer:
    """``dialect`` and ``mode`` (of canonical names) hold for every call; a text in another dialect is recognised for that text alone."""

    def __init__(self, dialect: str = "trino", mode: str = "full", registry: Registry | None = None):
        self.dialect, self.mode, self.registry = checked_dialect(dialect), mode, registry or Registry()
        self._corrected: tuple[str, str] | None = None

    def set_dialect(self, dialect: str) -> None:
        self.dialect = checked_dialect(dialect)

    def set_metadata_registry(self, registry: Registry) -> None:
        self.registry = registry

    def add_metadata_provider(self, provider: MetadataProvider) -> None:
        self.registry.add(provider)

    # one statement

    @timed
    def row(self, sql: str) -> dict:
        out = parsed_row(0, sql, self.dialect, self.mode)
        if out["dialect"] != self.dialect:
            self._corrected = (self.dialect, out["dialect"])
            log.info("dialect %s was corrected to %s", *self._corrected)
        return out

    def get_dialect_correction_info(self) -> dict | None:
        """The last text's dialect that was not the given one, if there was any."""
        return {"original_dialect": self._corrected[0], "corrected_dialect": self._corrected[1]} if self._corrected else None

    def reset_dialect_correction(self) -> None:
        self._corrected = None

    def analyze(self, sql: str) -> LineageResult:
        return self._result(self.row(sql))

    def _result(self, row: dict) -> LineageResult:
        doc = documents.lineage(row, self.registry.describe)
        side = lambda d: Side({k: set(v) for k, v in d["upstream"].items()}, {k: set(v) for k, v in d["downstream"].items()}, d["transformations"])
        return LineageResult(row["sql"], row["dialect"], side(doc["table_lineage"]), side(doc["column_lineage"]), doc["metadata"], row["errors"], row["warnings"], doc)

    def analyze_file(self, path: str) -> LineageResult:
        why = path_error(path)
        if not why:
            try:
                with open(path, encoding="utf-8") as f:
                    return self.analyze(f.read())
            except (OSError, UnicodeDecodeError) as e:
                why = str(e)
        return self._result(parsed_row(0, "", self.dialect) | {"errors": [f"Failed to read file {path}: {why}"]})

    def analyze_multiple(self, queries: list[str]) -> list[LineageResult]:
        return [self.analyze(q) for q in queries]

    def analyze_comprehensive(self, sql: str) -> dict:
        """The statement's kind and clauses; ``success`` is false where it can't be parsed."""
        if why := sql_error(sql):
            return {"sql": sql, "success": False, "error": why}
        try:
            statement, used = parse_any(sql, self.dialect)
        except SqlSyntaxError as e:
            return {"sql": sql, "dialect": self.dialect, "success": False, "error": f"Failed to parse SQL: {e}"}
        return {"sql": sql, "dialect": used, "success": True, **statements.describe(statement, used)}

    def get_lineage_json(self, sql: str) -> str:
        return render.as_json(self.analyze(sql).to_dict())

    # chains

    def _simple(self, sql: str, what: str, chain_type: str, depth: int) -> dict:
        if why := chain_error(chain_type, depth, 1):
            raise ValueError(why)
        return documents.simple_chain(self.row(sql), what, chain_type, depth)

    def get_table_lineage_chain(self, sql: str, chain_type: str = "upstream", depth: int = 1) -> dict:
        return self._simple(sql, "table", chain_type, depth)

    def get_table_lineage_chain_json(self, sql: str, chain_type: str = "upstream", depth: int = 1) -> str:
        return render.as_json(self.get_table_lineage_chain(sql, chain_type, depth))

    def get_column_lineage_chain(self, sql: str, chain_type: str = "upstream", depth: int = 1) -> dict:
        return self._simple(sql, "column", chain_type, depth)

    def get_column_lineage_chain_json(self, sql: str, chain_type: str = "upstream", depth: int = 1) -> str:
        return render.as_json(self.get_column_lineage_chain(sql, chain_type, depth))

    def get_lineage_chain(self, sql: str, chain_type: str = "upstream", depth: int = 0, target_entity: str | None = None) -> dict:
        if why := chain_error(chain_type, depth, 0):
            raise ValueError(why)
        return documents.lineage_chain(self.row(sql), chain_type, depth, target_entity, self.registry.describe)

    def get_lineage_chain_json(self, sql: str, chain_type: str = "upstream", depth: int = 0, target_entity: str | None = None) -> str:
        return render.as_json(self.get_lineage_chain(sql, chain_type, depth, target_entity))

    # many statements

    def corpus(self, rows: DataFrame, id_col: str = "stmt_id", sql_col: str = "sql") -> Corpus:
        """Relations over a table of statements, parsed on the executors."""
        return Corpus(parse_statements(rows, self.dialect, self.mode, id_col, sql_col))

    def corpus_of(self, spark: SparkSession, queries: list[str]) -> Corpus:
        return self.corpus(spark.createDataFrame(list(enumerate(queries, 1)), "stmt_id long, sql string"))


class LineageChainCombiner:
    """Chain documents of several statements, joined where one makes what another reads."""

    @staticmethod
    def process_lineage_data_complete(docs: list[dict]) -> list[dict]:
        return combine.combined_documents(docs)


class LineageEventMapper:
    def map_lineage_chain_to_events(self, lineage_json_string: str, tenant_id: str = "", association_type: str = "", association_id: str = "", query_id: str = "", state: str = "PERSISTENT") -> list[dict]:
        return events.chain_events(lineage_json_string, tenant_id=tenant_id, association_type=association_type, association_id=association_id, query_id=query_id, state=state)


class LineageVisualizer:
    """Diagrams as DOT text, or images where the ``dot`` program is installed."""

    def __init__(self, styles: dict | None = None):
        self.styles = styles or {}

    def get_supported_formats(self) -> list[str]:
        return list(render.FORMATS)

    def create_lineage_chain_diagram(self, chain_json: str, output_path: str = "lineage", output_format: str = "dot", layout: str = "horizontal", show_columns: bool = True, detail: bool = False) -> str:
        """With ``detail`` columns are ports with lines between them, and what is done is in boxes of its own."""
        dot = render.detailed_dot(chain_json, layout, self.styles) if detail else render.chain_dot(chain_json, layout, show_columns, self.styles)
        return render.write_diagram(dot, output_path, output_format)

    def create_table_only_diagram(self, table_chain_json: str, output_path: str = "lineage", output_format: str = "dot", layout: str = "horizontal") -> str:
        return render.write_diagram(render.simple_dot(table_chain_json, layout), output_path, output_format)

    def create_lineage_diagram(self, table_chain_json: str, column_chain_json: str | None = None, output_path: str = "lineage", output_format: str = "dot", layout: str = "horizontal") -> str:
        tables = json.loads(table_chain_json)
        both = tables if not column_chain_json else tables | {"chains": tables["chains"] | json.loads(column_chain_json)["chains"]}
        return render.write_diagram(render.simple_dot(both, layout), output_path, output_format)

    def create_column_focused_diagram(self, table_chain_json: str, column_chain_json: str, output_path: str = "lineage", output_format: str = "dot", layout: str = "horizontal") -> str:
        return render.write_diagram(render.simple_dot(column_chain_json, layout), output_path, output_format)
