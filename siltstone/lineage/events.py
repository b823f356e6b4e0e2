"""Flat lineage events: one for each distinct edge of a chain."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from datetime import datetime

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .naming import clean, clean_name

VERSION = "1.0.0"
#: Entity kinds that events show as tables.
AS_TABLE = ("cte", "query_result", "derived_table", "table", "subquery")


def event_type(kind: str) -> str:
    return "TABLE" if kind in AS_TABLE else kind.upper()


def event(source: str, source_type: str, target: str, target_type: str, metadata: dict, tenant_id: str = "", association_type: str = "", association_id: str = "", query_id: str = "", state: str = "PERSISTENT") -> dict:
    source, target, now = clean_name(source), clean_name(target), datetime.now().isoformat()
    return {
        "event_id": str(uuid.uuid4()),
        "event_version": VERSION,
        "timekey": now[:10].replace("-", ""),
        "timestamp": now,
        "query_id": query_id,
        "tenant_id": tenant_id,
        "workspace_id": tenant_id,
        "user_id": "",
        "source_table": source,
        "source_type": source_type,
        "source_id": f"{source_type.lower()}_{source.replace('.', '_')}",
        "source_path": "",
        "target_table": target,
        "target_type": target_type,
        "target_id": f"{target_type.lower()}_{target.replace('.', '_')}",
        "target_path": "",
        "metadata": metadata,
        "associated_type": association_type,
        "associated_id": association_id,
        "state": state,
    }


def merged(nodes: list[dict]) -> dict[str, dict]:
    """Metadata and transformations of each entity, over all its nodes."""
    out: dict[str, dict] = {}
    for n in nodes:
        own = out.setdefault(n["entity"], {"columns": {}, "transformations": {}, **{k: v for k, v in n["metadata"].items() if k != "table_columns"}})
        for c in n["metadata"].get("table_columns", []):
            known = own["columns"].setdefault(c["name"], dict(c, upstream=[]))
            known["upstream"] += [u for u in c["upstream"] if u not in known["upstream"]]
        for t in n.get("transformations", []):
            key = f"{t['type']}:{t['source_table']}->{t['target_table']}"
            known = own["transformations"].setdefault(key, dict(t))
            for part in ("joins", "filter_conditions", "group_by_columns", "having_conditions", "order_by_columns"):
                whole = [*known.get(part, []), *(x for x in t.get(part, []) if x not in known.get(part, []))]
                if whole:
                    known[part] = whole
    return out


def chain_events(document: dict | str, **told) -> list[dict]:
    """Events of a chain document: an edge once, none from an entity to itself."""
    doc = json.loads(document) if isinstance(document, str) else document
    from .documents import walk

    nodes = walk(doc["chains"])
    known, seen, out = merged(nodes), set(), []
    for n in nodes:
        for d in n["dependencies"]:
            pair = (n["entity"], d["entity"])
            if pair[0] == pair[1] or pair in seen:
                continue
            seen.add(pair)
            details = lambda name: {k: list(v.values()) if isinstance(v, dict) else v for k, v in known[name].items()}
            about = {"source": details(pair[0]), "target": details(pair[1]), "chain_type": doc["chain_type"], "depth": d["depth"]}
            out.append(event(pair[0], event_type(n["entity_type"]), pair[1], event_type(d["entity_type"]), about, **told))
    return out


def events_summary(events: list[dict]) -> dict[str, int]:
    return dict(Counter(f"{e['source_type']}->{e['target_type']}" for e in events))


def event_table(edges: DataFrame, entities: DataFrame, tenant_id: str = "", association_type: str = "", association_id: str = "", state: str = "PERSISTENT") -> DataFrame:
    """Events of a whole corpus, a row for each statement's distinct edge, downstream."""
    kind = lambda side: entities.select("stmt_id", F.col("name").alias(side), F.when(F.col("type").isin(*AS_TABLE), "TABLE").otherwise(F.upper("type")).alias(f"{side}_type"))
    e = edges.where("source <> target").distinct().join(kind("source"), ["stmt_id", "source"], "left").join(kind("target"), ["stmt_id", "target"], "left")
    named = lambda side: F.concat(F.lower(f"{side}_type"), F.lit("_"), F.replace(clean(F.col(side)), F.lit("."), F.lit("_")))
    none = F.lit("")
    return e.select(
        F.uuid().alias("event_id"), F.lit(VERSION).alias("event_version"), F.date_format(F.current_timestamp(), "yyyyMMdd").alias("timekey"), F.current_timestamp().cast("string").alias("timestamp"),
        F.concat(F.lit("query_"), F.col("stmt_id")).alias("query_id"), F.lit(tenant_id).alias("tenant_id"), F.lit(tenant_id).alias("workspace_id"), none.alias("user_id"),
        clean(F.col("source")).alias("source_table"), "source_type", named("source").alias("source_id"), none.alias("source_path"),
        clean(F.col("target")).alias("target_table"), "target_type", named("target").alias("target_id"), none.alias("target_path"),
        F.lit("{}").alias("metadata"), F.lit(association_type).alias("associated_type"), F.lit(association_id).alias("associated_id"), F.lit(state).alias("state"),
    )
