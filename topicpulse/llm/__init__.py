"""Operators for training data: text, pages, vectors. Nothing else in the library imports this."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "dedup_substring",
    "packing",
    "sentencepiece",
    "warc",
    "neighbours",
    "dedup_minhash",
    "pii",
    "toxicity",
    "extraction",
    "quality",
    "language",
    "clustering",
    "codebooks",
]


def _loaded():
    return [import_module(f"topicpulse.llm.{name}") for name in MODULES]


def queries() -> dict:
    """Every registered query as ``fn(spark, folder) -> DataFrame``."""
    return {name: run for module in _loaded() for name, run in module.QUERIES.items()}


def oracle_sql() -> dict:
    """DuckDB SQL of the queries that SQL can express."""
    return {name: sql for module in _loaded() for name, sql in module.ORACLE_SQL.items()}
