"""Registered queries: one key per inventory row, with its DuckDB check."""
from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

MODULES = ("trajectory", "catalog", "windows", "preserve", "ledger", "experiments", "decide",
           "curves", "signal", "plans", "streams")


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn
    return register


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
