"""Names of tables and columns: quotes, qualification, and one canonical name for each table."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

QUERY_RESULT, LITERAL = "QUERY_RESULT", "LITERAL"
MODES = ("disabled", "conservative", "full")


def clean_name(name: str) -> str:
    """Without quotes around the dotted parts."""
    return ".".join(p.strip().strip("\"'`[]") for p in name.split("."))


def base_name(name: str) -> str:
    return clean_name(name).rsplit(".", 1)[-1].lower()


def split_column(name: str) -> tuple[str | None, str | None, str]:
    """(schema, table, column) of a name of one to four parts; a catalog stays with its schema."""
    parts = clean_name(name).split(".")
    column = parts.pop()
    table = parts.pop() if parts else None
    return (".".join(parts) or None), table, column


def naming_classes(names: list[str]) -> dict[str, list[str]]:
    """Names by how they are qualified: simple, schema, catalog, and those with quotes."""
    out: dict[str, list[str]] = {"simple": [], "schema": [], "catalog": [], "quoted": []}
    for n in names:
        dots = clean_name(n).count(".")
        out["simple" if not dots else "schema" if dots == 1 else "catalog"].append(n)
        if any(q in n for q in "\"`["):
            out["quoted"].append(n)
    return out


def parts_of(name: str) -> tuple[str, ...]:
    """The dotted parts of a name, last first, without quotes and in lower case."""
    return tuple(reversed(clean_name(name).lower().split(".")))


def fullest(name: str, spellings: list[str]) -> str:
    """The spelling of the same table that says most about where it is.

    From the name's parts on, the part before them is added as long as all longer
    spellings agree on it: x, s.x and c.s.x are one table, while of a.x and b.x
    neither is x.  Of the names met on the way the last that was written is given.
    """
    at, best = parts_of(name), name
    while True:
        longer = [p for p in map(parts_of, spellings) if p[: len(at)] == at]
        if written := [n for n in spellings if parts_of(n) == at]:
            best = min(written, key=clean_name)
        before = {p[len(at)] for p in longer if len(p) > len(at)}
        if len(before) != 1:
            return best
        at = (*at, *before)


@dataclass
class TableNames:
    """The canonical name of each spelling met, by base name.

    ``conservative`` unifies only when spellings of several classes occur; ``full``
    always; ``disabled`` never.
    """

    dialect: str = "trino"
    mode: str = "full"
    _spellings: dict[str, list[str]] = field(default_factory=lambda: defaultdict(list))

    def register(self, names: list[str]) -> None:
        for n in names:
            if n not in self._spellings[base_name(n)]:
                self._spellings[base_name(n)].append(n)

    def _group(self, name: str) -> list[str]:
        """Spellings that may mean ``name``: one of the two ends by the other's parts."""
        own = parts_of(name)
        return [n for n in self._spellings.get(base_name(name), []) if all(x == y for x, y in zip(own, parts_of(n)))]

    def canonical(self, name: str) -> str:
        group = self._group(name)
        if self.mode == "disabled" or not group:
            return clean_name(name)
        if self.mode == "conservative" and len({len(parts_of(n)) for n in group}) == 1:
            return clean_name(name)
        return clean_name(fullest(name, group))

    def spellings(self, name: str) -> list[str]:
        return sorted(n for n in self._group(name) if self.canonical(n) == self.canonical(name))

    def tables(self) -> list[str]:
        return sorted({self.canonical(n) for names in self._spellings.values() for n in names})

    def is_canonical(self, name: str) -> bool:
        return self.canonical(name) == name

    def has_duplicates(self) -> bool:
        return any(len(self.spellings(n)) > 1 for n in self.tables())

    def summary(self) -> dict:
        return {"tables": len(self.tables()), "spellings": sum(map(len, self._spellings.values())), "mode": self.mode, "unified": {n: self.spellings(n) for n in self.tables() if len(self.spellings(n)) > 1}}


def clean(column: Column) -> Column:
    """``clean_name`` on a column of names."""
    return F.regexp_replace(column, r"[\"'`\[\]]", "")


def canonical_names(names: DataFrame, key: str = "stmt_id", name: str = "name") -> DataFrame:
    """key, name, canonical: what ``fullest`` gives for each of a key's spellings.

    The relation behind ``TableNames`` for corpora of any size.  Each spelling is
    joined to the endings of all spellings of its key; an ending that is followed
    by one part only is extended by it, so no spellings meet in pairs.
    """
    rows = names.select(key, F.col(name).alias("name")).distinct().withColumn("parts", F.reverse(F.split(F.lower(clean(F.col("name"))), r"\.")))
    # Every proper ending, with the part that comes before it in some spelling.
    steps = rows.select(key, "name", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n")).select(key, F.expr("slice(parts, 1, n)").alias("parts"), F.when(F.col("n") < F.size("parts"), F.expr("parts[n]")).alias("next"))
    # A spelling that is written so, for its own letters; the same ending in two ways is cut there.
    written = rows.groupBy(key, "parts").agg(F.min(clean(F.col("name"))).alias("written"))
    ways = steps.groupBy(key, "parts").agg(F.min("next").alias("one"), F.max("next").alias("other")).join(written, [key, "parts"], "left")
    ways = ways.select(key, "parts", "written", F.when(F.col("one") == F.col("other"), F.concat("parts", F.array("one"))).alias("longer"))
    # A name has at most four parts, so three steps reach the longest.
    at = rows.select(key, "name", F.col("parts").alias("at"), clean(F.col("name")).alias("canonical"))
    for _ in range(4):
        w = ways.select(F.col(key), F.col("parts").alias("at"), "written", "longer")
        at = at.join(w, [key, "at"], "left").select(key, "name", F.coalesce("longer", "at").alias("at"), F.coalesce("written", "canonical").alias("canonical"))
    return at.select(key, "name", "canonical")
