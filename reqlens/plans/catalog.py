"""Registry of query keys: a Spark callable and, where SQL can express it, the
DuckDB oracle statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from reqlens.plans import (q_requests, q_evaluate, q_split, q_tokens,  # noqa: F401
                               q_model, q_report)
