"""Registration of executable queries: a DataFrame builder and the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.sources.tables import Tables

Builder = Callable[[Tables], DataFrame]


class Family:
    """A group of named queries over the test tables."""

    def __init__(self):
        self.builders: dict[str, Builder] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
        def add(build: Builder) -> Builder:
            self.builders[name] = build
            if sql:
                self.oracles[name] = sql
            return build

        return add

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return {n: (lambda spark, sf_dir, b=b: b(Tables(spark, sf_dir))) for n, b in self.builders.items()}
