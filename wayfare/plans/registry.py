"""Registered queries and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import SQL as BASE
from ..sources.fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *, base: bool = True) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a query under its function's name; ``sql`` may start with further common table expressions and a comma-free SELECT."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = f.__name__
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            body = sql.strip()
            recursive = "RECURSIVE " if body.startswith("RECURSIVE ") else ""
            body = body.removeprefix("RECURSIVE ")
            SQL[name] = (f"WITH {recursive}{BASE.strip()}" + (",\n" if not body.upper().startswith("SELECT") else "\n") + body) if base else body
        return f

    return keep
