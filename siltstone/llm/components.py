"""Connected components by alternating large-star and small-star, as DataFrame joins."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` of each node in ``edges(a, b)``; the component is its least node.

    Every star step joins two tables read from the shared folder, so a node with
    very many neighbours is split by adaptive execution instead of meeting in
    one task, and nothing is collected but a count and a checksum a round.
    Loops, repeated and null edges are dropped; without edges there are no rows.
    """
    e = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v").distinct(), "edges")
    seen = _state(e)
    while seen[0]:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-min")
        large = scratch.save(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        scratch.drop(e, low)
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "small-min")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.save(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        scratch.drop(large, low)
        now = _state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
