"""Query catalogue: every operator of the survey that runs on the test tables
is registered here with its Spark form and, where SQL can express it, the
equivalent DuckDB SQL (the correctness oracle)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None, ops: str = ""):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, tuple(ops.split()))
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    import importlib

    for mod in MODULES:
        importlib.import_module(f"opinia.plans.{mod}")
    return QUERIES


MODULES = ("q_text", "q_nested", "q_prep", "q_features", "q_models", "q_scoring", "q_mllib", "q_io", "q_edges", "q_checks", "q_text_models", "q_review_models")
