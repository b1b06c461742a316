"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registered:
    name: str
    build: Builder
    sql: str | None  # None: no SQL form (ML output / iterative) -> rows-only check


REGISTRY: dict[str, Registered] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Registered(name, fn, sql)
        return fn
    return deco


def load_all() -> dict[str, Registered]:
    # Importing the modules registers their queries.
    from herdlens.plans import (  # noqa: F401
        q_clean, q_encoders, q_ml, q_refresh, q_reports, q_rules, q_sources, q_streams, q_updates,
    )
    return REGISTRY
