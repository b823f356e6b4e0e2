"""All queries of the library by name, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.functions import scalars, userdefined
from siltstone.operators import aggregates, ctes, joins, scans, setops, windows
from siltstone.plans import generated_queries, lineage_queries
from siltstone.streaming import queries as streams

FAMILIES = [f.family for f in (scans, joins, aggregates, windows, setops, ctes, scalars, userdefined, lineage_queries, generated_queries, streams)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _f in FAMILIES:
    QUERIES |= _f.queries()
    ORACLES |= _f.oracles

#: The query that the smoke check runs.
FLAGSHIP = "cte_chain"
