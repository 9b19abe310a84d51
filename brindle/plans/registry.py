"""Queries by name and their SQL; the modules of this folder add theirs."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name``, with the SQL that gives the same rows."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from importlib import import_module

    for name in ("ranking", "scalars", "search", "tabular", "regions", "vocabulary", "clustering", "exchange", "imaging"):
        import_module(f"brindle.plans.{name}")
