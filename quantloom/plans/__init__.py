"""Registered queries: each applies operators to market-shaped views of the given tables."""

from __future__ import annotations

import importlib

MODULES = ("market", "research", "events", "boards", "studies", "ingest")


def _load():
    for m in MODULES:
        importlib.import_module(f"quantloom.plans.{m}")


def queries() -> dict:
    _load()
    from quantloom.plans.registry import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    from quantloom.plans.registry import ORACLES

    return dict(ORACLES)
