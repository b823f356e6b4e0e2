"""Functions, aggregates and table functions that users define, and queries with each kind.

They run in Python over Arrow batches.  An aggregate has a state that is made in
each partition, packed, and merged after the shuffle: a hot group costs one small
row a partition, and no group is gathered in one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.operators.base import Family

family = Family()
query = family.query


class Aggregator:
    """An aggregate: a state from nothing, with a row added, of two states, and its value."""

    def zero(self) -> Any:
        raise NotImplementedError

    def add(self, state: Any, row: tuple) -> Any:
        raise NotImplementedError

    def merge(self, state: Any, other: Any) -> Any:
        raise NotImplementedError

    def value(self, state: Any) -> Any:
        return state


#: Groups whose states a task holds before it hands them on.
MOST_GROUPS = 50_000


def aggregate(df: DataFrame, keys: list[str], columns: list[str], aggregator: Aggregator, name: str, kind: str) -> DataFrame:
    """``keys`` and, as the column ``name`` of type ``kind``, the aggregate of ``columns``; null keys are a group."""
    held = df.select(*keys, *columns)
    fields = [held.schema[k] for k in keys]
    state = T.StructField("state_", T.BinaryType())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = row[: len(keys)]
                states[key] = aggregator.add(states[key] if key in states else aggregator.zero(), row[len(keys) :])
            if len(states) > MOST_GROUPS:
                yield packed(states, kinds)
                states = {}
        if states:
            yield packed(states, kinds)

    def packed(states: dict[tuple, Any], kinds: list) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*states), kinds)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], names=[*keys, "state_"])

    def merged(states: list[bytes]) -> Any:
        total = pickle.loads(states[0])
        for s in states[1:]:
            total = aggregator.merge(total, pickle.loads(s))
        return aggregator.value(total)

    parts = held.mapInArrow(partial, T.StructType([*fields, state]))

    def finished(states: pd.Series) -> pd.Series:
        return states.map(merged)

    finish = F.pandas_udf(finished, kind)
    # A state a partition: the list is as long as there are partitions.
    return parts.groupBy(*keys).agg(F.collect_list("state_").alias("states_")).select(*keys, finish("states_").alias(name))


def table_function(df: DataFrame, function: Callable[..., Iterator[tuple]], arguments: list[str], kept: list[str], schema: str) -> DataFrame:
    """``kept`` columns beside each row that ``function`` gives for a row's ``arguments``."""
    made = T._parse_datatype_string(schema)
    held = df.select(*kept, *(F.col(a).alias(f"argument_{k}") for k, a in enumerate(arguments)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*row[: len(kept)], *out) for row in batch.itertuples(index=False, name=None) for out in function(*row[len(kept) :])]
            yield pd.DataFrame(rows, columns=[*kept, *made.names])

    return held.mapInPandas(run, T.StructType([*(df.schema[k] for k in kept), *made.fields]))


def backwards(text: pd.Series) -> pd.Series:
    return text.str[::-1]


@query("udf_scalar", "SELECT c_custkey, reverse(c_name) AS backwards FROM customer")
def udf_scalar(t):
    return t("customer").select("c_custkey", F.pandas_udf(backwards, T.StringType())("c_name").alias("backwards"))


class WeightedMean(Aggregator):
    def zero(self):
        return 0.0, 0.0

    def add(self, state, row):
        value, weight = row
        return (state[0] + value * weight, state[1] + weight) if value is not None and weight is not None else state

    def merge(self, state, other):
        return state[0] + other[0], state[1] + other[1]

    def value(self, state):
        return round(state[0] / state[1], 4) if state[1] else None


@query("udaf_weighted_mean", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus")
def udaf_weighted_mean(t):
    return aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_quantity"], WeightedMean(), "mean", "double")


def numbered_words(text: str | None) -> Iterator[tuple[int, str]]:
    yield from enumerate((text or "").split(" "), 1)


@query("udtf_words", "SELECT p_partkey, CAST(k AS BIGINT) AS place, string_split(p_type, ' ')[k] AS word FROM part, LATERAL (SELECT unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS k)")
def udtf_words(t):
    return table_function(t("part"), numbered_words, ["p_type"], ["p_partkey"], "place long, word string")
