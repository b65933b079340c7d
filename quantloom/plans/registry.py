"""Queries and their SQL counterparts, registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from quantloom.plans import views as V

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
BODIES: dict[str, Callable] = {}  # fn(views), for queries that are made of others


def query(name: str, sql: str | None = None):
    """Registers fn(views) -> DataFrame. `sql` follows the shared CTEs (starts with ', x AS' or 'SELECT')."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        BODIES[name] = fn
        QUERIES[name] = lambda spark, sf_dir: fn(V.Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = V.SQL_BASE + sql
        return fn

    return wrap


def nested(name: str, cte: str) -> str:
    """The SQL of a registered query as one CTE of another one."""
    own = ORACLES[name].removeprefix(V.SQL_BASE)
    return f", {cte} AS (" + (f"WITH RECURSIVE {own[2:]}" if own.startswith(", ") else own) + ")"
