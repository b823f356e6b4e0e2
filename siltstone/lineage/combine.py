"""Chains over several statements: who makes a table, who reads it.

At scale these are joins over the corpus' edges: ``producers``, ``consumers`` and
``query_edges`` are relations, and ``graph.closure`` over ``query_edges`` gives
reach.  ``combined_documents`` renders a handful of statements as nested
documents, as one query chain each.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from . import documents
from .naming import QUERY_RESULT
from .parser import deep


def producers(edges: DataFrame, statements: DataFrame) -> DataFrame:
    """table_name, stmt_id: the last statement that writes each table (of equal tables the largest id)."""
    written = statements.where("target is not null").select("stmt_id", "target")
    made = edges.join(written, ["stmt_id", "target"], "left_semi").select(F.col("target").alias("table_name"), "stmt_id")
    return made.groupBy("table_name").agg(F.max("stmt_id").alias("stmt_id"))


def consumers(edges: DataFrame, statements: DataFrame, entities: DataFrame) -> DataFrame:
    """table_name, stmt_id of every base table that a statement reads."""
    inner = entities.where("type in ('cte', 'derived_table', 'query_result')").select("stmt_id", F.col("name").alias("source"))
    own = statements.select("stmt_id", F.col("target").alias("source"))
    read = edges.join(inner, ["stmt_id", "source"], "left_anti").join(own, ["stmt_id", "source"], "left_anti")
    return read.select(F.col("source").alias("table_name"), "stmt_id").distinct()


def query_edges(made: DataFrame, read: DataFrame) -> DataFrame:
    """table_name, producer, consumer."""
    return made.withColumnRenamed("stmt_id", "producer").join(read.withColumnRenamed("stmt_id", "consumer"), "table_name").where("producer <> consumer")


def isolated(statements: DataFrame, links: DataFrame) -> DataFrame:
    """stmt_id of statements without any link."""
    used = links.select(F.col("producer").alias("stmt_id")).union(links.select("consumer")).distinct()
    return statements.select("stmt_id").join(used, "stmt_id", "left_anti")


# documents


def flow(doc: dict) -> list[dict]:
    """All nodes of a chain document by depth."""
    return sorted(documents.walk(doc["chains"]), key=lambda n: n["depth"])


def roles(docs: list[dict]) -> tuple[dict[str, int], dict[str, list[int]]]:
    """Producer and consumers (places in the list) of each table; the later producer wins."""
    made: dict[str, int] = {}
    read: dict[str, list[int]] = {}
    for k, doc in enumerate(docs):
        nodes = documents.walk(doc["chains"])
        for n in nodes:
            name, kind = n["entity"], n["entity_type"]
            if name == QUERY_RESULT or kind in ("cte", "derived_table", "query_result"):
                continue
            if n["dependencies"] or n["depth"] == 0 and len(nodes) == 1:
                if k not in read.setdefault(name, []):
                    read[name].append(k)
            if not n["dependencies"] and n["depth"]:
                made[name] = k
    return made, read


#: Chains that are listed one by one; of more, each start has one that holds all it leads to.
MOST_CHAINS = 256


def chains(docs: list[dict]) -> list[list[int]]:
    """All chains of statements from one without a producer to one without a consumer; those without links alone.

    A circle is cut where it closes; where nothing is without a producer, the
    first statement begins.  Where more than MOST_CHAINS ways lead on, as their
    number can double with every statement, each start gives one chain instead:
    all statements that it leads to, producers before consumers.
    """
    made, read = roles(docs)
    below: dict[int, list[int]] = {}
    for table, k in made.items():
        for c in read.get(table, []):
            if c != k and c not in below.setdefault(k, []):
                below[k].append(c)
    below = {k: sorted(cs) for k, cs in below.items()}
    led = {c for cs in below.values() for c in cs}
    starts = [k for k in range(len(docs)) if k not in led]
    order = [*starts, *range(len(docs))]
    ways = _ways(below, order)
    return [_reached(below, k) for k in _first_of(below, order)] if ways is None else ways


def _ways(below: dict[int, list[int]], order: list[int]) -> list[list[int]] | None:
    """Every simple way on from the starts, or None where there are too many."""
    out: list[list[int]] = []
    seen: set[int] = set()
    steps = 0
    for start in order:
        if start in seen:
            continue
        left, here = [[start]], []
        while left:
            path = left.pop()
            steps += 1
            more = [c for c in below.get(path[-1], []) if c not in path]
            if not more:
                here.append(path)
            left += [[*path, c] for c in reversed(more)]
            if len(out) + len(here) > MOST_CHAINS or steps > 64 * MOST_CHAINS:
                return None
        out += here
        seen |= {x for p in here for x in p}
    return out


def _first_of(below: dict[int, list[int]], order: list[int]) -> list[int]:
    """Starts of which none leads to another."""
    out, seen = [], set()
    for k in order:
        if k not in seen:
            out.append(k)
            seen.update(_reached(below, k))
    return out


def _reached(below: dict[int, list[int]], start: int) -> list[int]:
    """All that a statement leads to, itself first, each after those that lead to it (but for circles)."""
    done, state, left = [], {start: iter(below.get(start, []))}, [start]
    while left:
        c = next(state[left[-1]], None)
        if c is None:
            done.append(left.pop())
        elif c not in state:
            state[c] = iter(below.get(c, []))
            left.append(c)
    return done[::-1]


def combined_documents(docs: list[dict]) -> list[dict]:
    """One document for each chain of statements, whose nodes flow on from producer to consumer."""
    out = []
    for number, path in enumerate(chains(docs), 1):
        nodes: dict[str, dict] = {}
        below: dict[str, list[str]] = {}
        for k in path:
            for n in documents.walk(docs[k]["chains"]):
                own = nodes.setdefault(n["entity"], {"entity": n["entity"], "entity_type": n["entity_type"], "metadata": n["metadata"], "transformations": [], "queries": []})
                own["queries"] += [f"query_{k + 1}"] if f"query_{k + 1}" not in own["queries"] else []
                known = {c["name"] for c in own["metadata"]["table_columns"]}
                if own["metadata"] is not n["metadata"]:
                    extra = [c | {"context": "consumer"} for c in n["metadata"]["table_columns"] if c["name"] not in known]
                    own["metadata"] = own["metadata"] | {"table_columns": [*own["metadata"]["table_columns"], *extra]}
                own["transformations"] += [t for t in n.get("transformations", []) if t not in own["transformations"]]
                for d in n["dependencies"]:
                    if d["entity"] not in below.setdefault(n["entity"], []):
                        below[n["entity"]].append(d["entity"])

        written = documents.Written()

        def node(name: str, level: int, seen: tuple[str, ...]) -> dict:
            own = nodes[name]
            if written.again(name):
                return {"entity": name, "entity_type": own["entity_type"], "depth": level, "dependencies": [], "metadata": {"table_columns": []}, "repeated": True}
            made = {k: v for k, v in own.items() if k != "queries" and (v or k != "transformations")}
            made |= {"depth": level, "dependencies": [node(x, level + 1, (*seen, name)) for x in below.get(name, []) if x not in seen and x != name]}
            if len(own["queries"]) > 1:
                made |= {"is_connection_point": True, "is_merged_connection": True, "producer_query": own["queries"][0], "consumer_query": own["queries"][-1]}
            return made

        lower = {x for xs in below.values() for x in xs}
        starts = [n for n in nodes if n not in lower] or list(nodes)[:1]
        with deep(len(nodes)):
            tree = {n: node(n, 0, ()) for n in starts}
        every = documents.walk(tree)
        out.append(
            {
                "sql": "\n\n".join(f"-- query_{k + 1}\n{docs[k]['sql']}" for k in path),
                "dialect": docs[path[0]]["dialect"],
                "chain_type": "combined_downstream",
                "max_depth": "unlimited",
                "actual_max_depth": len(path) - 1,
                "target_entity": f"combined_chain_{number}",
                "queries": [f"query_{k + 1}" for k in path],
                "chains": tree,
                "summary": {"total_tables": len({n["entity"] for n in every if n["entity_type"] == "table"}), "total_columns": sum(docs[k]["summary"]["total_columns"] for k in path), "has_transformations": any(docs[k]["summary"]["has_transformations"] for k in path), "has_metadata": any(docs[k]["summary"]["has_metadata"] for k in path), "chain_count": 1},
                "errors": [],
                "warnings": written.warnings(),
            }
        )
    return out
