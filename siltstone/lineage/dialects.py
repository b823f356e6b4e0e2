"""Dialects: which are known, and which of them have the constructs that a text uses.

The grammar takes the constructs of all dialects and notes those that not every
dialect has.  A text that uses one which its dialect refuses is taken to be in a
dialect that has all of them.
"""

from __future__ import annotations

from .parser import parse
from .syntax import SqlSyntaxError, Statement

# Names of dialects that are accepted, and other names of the same.
DIALECTS = ("athena", "bigquery", "clickhouse", "databricks", "drill", "duckdb", "hive", "mysql", "oracle", "postgres", "presto", "redshift", "snowflake", "spark", "sqlite", "trino", "tsql")
ALSO = {"mssql": "tsql", "postgresql": "postgres"}

_ALL = frozenset(DIALECTS)
# The manuals' answers to which dialects have a construct that the parser names.
HAVE: dict[str, frozenset[str]] = {
    "(+)": frozenset({"oracle", "redshift", "snowflake"}),
    "::": frozenset({"clickhouse", "databricks", "duckdb", "postgres", "redshift", "snowflake"}),
    "APPLY": frozenset({"oracle", "tsql"}),
    "CONNECT BY": frozenset({"oracle", "redshift", "snowflake"}),
    "LATERAL VIEW": frozenset({"databricks", "hive", "spark"}),
    "LIMIT": _ALL - {"oracle", "tsql"},
    "MATCH_RECOGNIZE": frozenset({"athena", "oracle", "snowflake", "trino"}),
    "ON CONFLICT": frozenset({"duckdb", "postgres", "sqlite"}),
    "ON DUPLICATE KEY": frozenset({"mysql"}),
    "PATH": frozenset({"databricks", "snowflake"}),
    "QUALIFY": frozenset({"bigquery", "clickhouse", "databricks", "duckdb", "redshift", "snowflake"}),
    "TOP": frozenset({"redshift", "snowflake", "tsql"}),
    "[NAME]": frozenset({"sqlite", "tsql"}),
    "`NAME`": frozenset({"bigquery", "clickhouse", "databricks", "drill", "hive", "mysql", "spark", "sqlite"}),
    "~": frozenset({"duckdb", "postgres", "redshift"}),
}
#: Of these the constructs that are errors in other dialects; the others only tell likely dialects from unlikely ones.
STRICT = frozenset({"(+)", "APPLY", "LIMIT", "PATH", "TOP"})


def known_as(dialect: str) -> str | None:
    """The name by which a dialect is known here."""
    name = dialect.strip().lower()
    name = ALSO.get(name, name)
    return name if name in _ALL else None


def accepts(dialect: str, constructs: set[str]) -> bool:
    return all(dialect in HAVE[c] for c in constructs & STRICT)


def candidates(sql: str) -> list[str]:
    """Dialects that a text can be in, the likeliest first."""
    return _likely(parse(sql).constructs)


def _likely(constructs: set[str]) -> list[str]:
    """Dialects that accept the constructs: those that have most of them first, of these the ones that fewest others share a construct with."""
    noted = [HAVE[c] for c in constructs if c in HAVE]
    weight = {d: sum(1 for have in noted if d in have) for d in DIALECTS}
    special = {d: sum(d in have for have in HAVE.values()) for d in DIALECTS}
    return sorted((d for d in DIALECTS if accepts(d, constructs)), key=lambda d: (-weight[d], special[d], d))


def parse_any(sql: str, dialect: str) -> tuple[Statement, str]:
    """The statement, and the dialect it is in: the given one, else the likeliest that has all its constructs."""
    statement = parse(sql, dialect)
    if accepts(dialect, statement.constructs):
        return statement, dialect
    for other in _likely(statement.constructs):
        try:
            # The other dialect may quote in another way.
            return parse(sql, other), other
        except SqlSyntaxError:
            pass
    raise SqlSyntaxError(f"no dialect has all of {', '.join(sorted(statement.constructs & STRICT))}")
