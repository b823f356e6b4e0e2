"""Graphs as edge tables: closure, depth, cycles, roots, shortest paths.

Edges are rows (key, parent, child); keys are separate graphs (statements), so one
run serves a corpus of any size.  Each step is one join of the newest rows with
the edges on (key, node), after which rows already known are dropped: a hot node
is split by adaptive execution, and nothing is collected but a count a step.
Every ``CUT`` steps the lineage is cut by a checkpoint in the shared folder.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from siltstone.sources.session import shared_folder

CUT = 4


def cut(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder, so that a lost executor costs no earlier step."""
    shared_folder(df.sparkSession, "graph")  # registers a folder for a local session without one
    return df.checkpoint()


def closure(edges: DataFrame, key: str, parent: str, child: str, max_depth: int | None = None) -> DataFrame:
    """key, root, node, depth: each node reachable from each parent, with the length of its shortest path.

    A node on a cycle reaches itself.
    """
    e = cut(edges.select(F.col(key).alias("key"), F.col(parent).alias("parent"), F.col(child).alias("child")).distinct())
    found = e.select("key", F.col("parent").alias("root"), F.col("child").alias("node"), F.lit(1).alias("depth"))
    front, depth = found, 1
    while max_depth is None or depth < max_depth:
        step = front.select("key", "root", F.col("node").alias("parent")).join(e, ["key", "parent"]).select("key", "root", F.col("child").alias("node")).distinct()
        front = step.join(found, ["key", "root", "node"], "left_anti").withColumn("depth", F.lit(depth + 1))
        front = cut(front)
        if front.isEmpty():
            break
        found, depth = found.union(front), depth + 1
        if depth % CUT == 0:
            found = cut(found)
    return found.withColumnRenamed("key", key)


def paths(edges: DataFrame, key: str, parent: str, child: str, roots: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """key, root, parent, node, depth, path, is_cycle: every simple path from the roots; a path ends where it meets itself.

    For rendering single statements; over dense graphs use ``closure``, which keeps one row a pair.
    """
    e = cut(edges.select(F.col(key).alias("key"), F.col(parent).alias("p"), F.col(child).alias("c")).distinct())
    starts = roots.select(F.col(key).alias("key"), F.col("root")) if roots is not None else e.select("key", F.col("p").alias("root"))
    front = starts.distinct().select("key", "root", F.lit(None).cast("string").alias("parent"), F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path"), F.lit(False).alias("is_cycle"))
    found, depth = front, 0
    while max_depth is None or depth < max_depth:
        live = front.where("not is_cycle").withColumnRenamed("node", "p")
        step = live.join(e, ["key", "p"])
        front = cut(step.select("key", "root", F.col("p").alias("parent"), F.col("c").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("c")).alias("path"), F.array_contains("path", F.col("c")).alias("is_cycle")))
        if front.isEmpty():
            break
        found, depth = found.union(front), depth + 1
    return found.withColumnRenamed("key", key)


def depths(edges: DataFrame, key: str, parent: str, child: str) -> DataFrame:
    """key, node, depth: the length of the longest path that ends at a node; 0 for roots.

    For graphs without cycles; nodes on or behind a cycle are left out.
    """
    e = cut(edges.select(F.col(key).alias("key"), F.col(parent).alias("p"), F.col(child).alias("c")).distinct())
    nodes = e.select("key", F.col("p").alias("node")).union(e.select("key", "c")).distinct()
    done = cut(nodes.join(e.select("key", F.col("c").alias("node")), ["key", "node"], "left_anti").withColumn("depth", F.lit(0)))
    level, left = done, e
    while True:
        # Edges out of finished nodes go; what no edge leads to any more is next.
        left = cut(left.join(level.select("key", F.col("node").alias("p")), ["key", "p"], "left_anti"))
        below = level.select("key", F.col("node").alias("p")).join(e, ["key", "p"]).select("key", F.col("c").alias("node")).distinct()
        ready = below.join(left.select("key", F.col("c").alias("node")), ["key", "node"], "left_anti")
        above = ready.withColumnRenamed("node", "c").join(e, ["key", "c"]).join(done.select("key", F.col("node").alias("p"), "depth"), ["key", "p"])
        level = cut(above.groupBy("key", F.col("c").alias("node")).agg((F.max("depth") + 1).alias("depth")))
        if level.isEmpty():
            break
        done = cut(done.union(level))
    return done.withColumnRenamed("key", key)


def cycles(edges: DataFrame, key: str, parent: str, child: str) -> DataFrame:
    """key, node of each node that reaches itself."""
    return closure(edges, key, parent, child).where("root = node").select(key, "node")


def roots(edges: DataFrame, key: str, parent: str, child: str) -> DataFrame:
    """key, node of the parents that are nobody's child."""
    below = edges.select(F.col(key), F.col(child).alias("node")).distinct()
    return edges.select(F.col(key), F.col(parent).alias("node")).distinct().join(below, [key, "node"], "left_anti")


def leaves(edges: DataFrame, key: str, parent: str, child: str) -> DataFrame:
    return roots(edges, key, child, parent)


def fanout(edges: DataFrame, key: str, parent: str, child: str) -> DataFrame:
    """key, node, n: distinct children of each parent."""
    return edges.select(F.col(key), F.col(parent).alias("node"), F.col(child).alias("child")).distinct().groupBy(key, "node").agg(F.count("*").alias("n"))
