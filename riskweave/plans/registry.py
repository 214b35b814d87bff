"""Named queries over the test tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from riskweave.plans.views import sql_prelude

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: Sequence[str] = ("tx",), ctes: Sequence[str] = ()):
    """Register a query; ``sql`` is the final SELECT over the named views and CTEs."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            parts = [*sql_prelude(*views)]
            for text in ctes:
                if text not in parts:
                    parts.append(text)
            recursive = "RECURSIVE " if any("/*recursive*/" in p for p in parts) else ""
            ORACLES[name] = (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + sql
        return fn

    return register
