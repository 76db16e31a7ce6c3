"""Queries of the corpus operators, with their DuckDB texts where SQL can say them."""
from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

MODULES = ("mixing", "sharding", "line_rules", "rule_ensemble", "near_dups", "bpe", "vector_dups", "packing",
           "separator_scan", "licences", "merkle", "squares", "hard_negatives")


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn
    return register


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    for name in MODULES:
        import_module(f"archlens.llm.{name}")
    QUERIES["pipeline"] = import_module("corpus_pipeline").run
