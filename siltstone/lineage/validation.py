"""Checks of what comes in: each gives a message, or None where nothing is wrong."""

from __future__ import annotations

from pathlib import PurePath

from .dialects import DIALECTS, known_as

#: Fixed value: characters that a statement may have.
MOST_CHARACTERS = 1_000_000
#: Characters that open redirections in a shell or end a path in C; no path of a statement's file has them.
_NO_PATH = frozenset("<>|\0")
WAYS = ("upstream", "downstream")


def _blank(what: str, value) -> str | None:
    """That ``value`` is no text, or a blank one."""
    if value is not None and not isinstance(value, str):
        return f"{what} is to be a text, not {type(value).__name__}"
    return None if value and not value.isspace() else f"{what} is empty"


def sql_error(sql) -> str | None:
    """Why a text can't be analysed."""
    if problem := _blank("the statement", sql):
        return problem
    excess = len(sql) - MOST_CHARACTERS
    return f"the statement is too long by {excess:,} characters" if excess > 0 else None


def dialect_error(dialect) -> str | None:
    if problem := _blank("the dialect", dialect):
        return problem
    return None if known_as(dialect) else f"no dialect is called {dialect}; there are {', '.join(DIALECTS)}"


def checked_dialect(dialect) -> str:
    """The dialect's own name; ValueError where there is none."""
    if problem := dialect_error(dialect):
        raise ValueError(problem)
    return known_as(dialect)


def path_error(path) -> str | None:
    if isinstance(path, PurePath):
        path = str(path)
    if problem := _blank("the path", path):
        return problem
    odd = sorted(_NO_PATH.intersection(path))
    return f"the path holds {', '.join(map(repr, odd))}" if odd else None


def chain_error(chain_type: str, depth: int, least: int) -> str | None:
    if chain_type not in WAYS:
        return f"chain_type is to be one of {', '.join(WAYS)}"
    return None if isinstance(depth, int) and depth >= least else f"depth must be {least} or greater"
