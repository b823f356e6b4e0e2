"""Metadata of tables from outside the SQL; the first provider that answers wins."""

from __future__ import annotations

import json
from typing import Protocol

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .naming import clean_name


class MetadataProvider(Protocol):
    def table(self, name: str) -> dict | None:
        """catalog, schema, table_type, description, owner, row_count, storage_format, columns; None if unknown."""


class CatalogProvider:
    """Tables and views of a Spark session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def table(self, name: str) -> dict | None:
        name = clean_name(name)
        if not self.spark.catalog.tableExists(name):
            return None
        t = self.spark.catalog.getTable(name)
        columns = [{"name": c.name, "data_type": c.dataType, "nullable": c.nullable, "primary_key": False, "foreign_key": None, "description": c.description} for c in self.spark.catalog.listColumns(name)]
        return {"catalog": t.catalog, "schema": ".".join(t.namespace or ()) or "default", "table_type": "VIEW" if t.tableType in ("VIEW", "TEMPORARY") else "TABLE", "description": t.description or "Table information", "columns": columns}


class DictProvider:
    """Tables of a dictionary from names to metadata; names match by their last parts."""

    def __init__(self, tables: dict[str, dict]):
        self.tables = {clean_name(k).lower(): v for k, v in tables.items()}

    def table(self, name: str) -> dict | None:
        name = clean_name(name).lower()
        return self.tables.get(name) or self.tables.get(name.rsplit(".", 1)[-1])


class JsonProvider(DictProvider):
    """A JSON file of such a dictionary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            super().__init__(json.load(f))


class ColumnsProvider:
    """A table of columns as databases keep it: table_schema, table_name, column_name, data_type, is_nullable.

    It may be any DataFrame, also one read over JDBC; each question is a filter that reaches its source.
    """

    def __init__(self, columns: DataFrame):
        self.columns = columns

    def table(self, name: str) -> dict | None:
        schema, _, base = clean_name(name).rpartition(".")
        rows = self.columns.where(F.lower("table_name") == base.lower())
        if schema:
            rows = rows.where(F.lower("table_schema") == schema.rpartition(".")[2].lower())
        found = rows.collect()  # one table's columns
        if not found:
            return None
        columns = [{"name": r["column_name"], "data_type": r["data_type"], "nullable": r["is_nullable"] in (True, "YES"), "primary_key": False} for r in found]
        return {"schema": found[0]["table_schema"], "table_type": "TABLE", "description": "Table information", "columns": columns}


class Registry:
    """Providers in the order in which they are asked."""

    def __init__(self, *providers: MetadataProvider):
        self.providers = list(providers)

    def add(self, provider: MetadataProvider) -> None:
        self.providers.append(provider)

    def describe(self, name: str) -> dict | None:
        for p in self.providers:
            if (found := p.table(name)) is not None:
                return found
        return None


def sample_registry() -> Registry:
    """A few described tables, for trying things out."""
    column = lambda name, kind, key=False: {"name": name, "data_type": kind, "nullable": not key, "primary_key": key}
    return Registry(
        DictProvider(
            {
                "users": {"schema": "default", "table_type": "TABLE", "description": "People who registered", "owner": "accounts", "row_count": 1_000_000, "columns": [column("id", "BIGINT", True), column("name", "VARCHAR"), column("email", "VARCHAR"), column("age", "INTEGER"), column("region", "VARCHAR"), column("active", "BOOLEAN")]},
                "orders": {"schema": "default", "table_type": "TABLE", "description": "Orders of users", "owner": "sales", "row_count": 5_000_000, "columns": [column("id", "BIGINT", True), column("user_id", "BIGINT"), column("order_date", "DATE"), column("total", "DOUBLE")]},
                "products": {"schema": "default", "table_type": "TABLE", "description": "What is on sale", "owner": "catalog", "row_count": 100_000, "columns": [column("product_id", "BIGINT", True), column("product_name", "VARCHAR"), column("category_id", "BIGINT"), column("price", "DOUBLE")]},
            }
        )
    )
