"""Registry of named queries over the driver's tables and their DuckDB oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame``; the oracle is SQL over the views
``region nation customer ... conversations``. Computed doubles are presented
rounded to 6 places in both engines (``r6``) so that summation order cannot
change a value hash; integer and string columns are compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
SQL_EXEMPT: dict[str, str] = {}


def query(name: str, sql: str | None = None, no_sql_reason: str | None = None):
    """Register ``fn`` under ``name`` with its oracle (or the reason it has none)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        else:
            SQL_EXEMPT[name] = no_sql_reason or "not expressible in SQL"
        return fn
    return deco


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), 6)
    alias = name or (c if isinstance(c, str) else None)
    return out.alias(alias) if alias else out


def with_cte(**ctes: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix from keyword arguments, in order."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n"


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        fill_queries, column_queries, join_queries, split_queries,
        triplet_queries, metric_queries, io_queries, composed_queries,
    )
