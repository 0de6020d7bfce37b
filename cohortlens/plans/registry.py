"""Registry of named queries over the test tables.

Each query is ``(spark, sf_dir) -> DataFrame``; the matching DuckDB SQL (when
the result is expressible in SQL) is registered under the same name. Modules
register with the ``query`` decorator; ``all_queries``/``all_oracles`` import
them all.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}

MODULES = (
    "cohortlens.plans.panel_queries",
    "cohortlens.plans.describe_queries",
    "cohortlens.plans.text_queries",
    "cohortlens.plans.model_queries",
    "cohortlens.plans.source_queries",
)


def query(name: str, sql: str | None = None):
    """Register ``fn`` as query ``name`` with an optional DuckDB oracle."""
    def deco(fn: QueryFn) -> QueryFn:
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return deco


def _load() -> None:
    for m in MODULES:
        try:
            importlib.import_module(m)
        except ModuleNotFoundError as e:  # a module not written yet
            if e.name != m:
                raise


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
