"""The registered queries of the reference operators over the driver's tables, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        if f.__name__ in FOUND:
            raise ValueError(f"{f.__name__} is registered twice")
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    from sonde.queries import evaluation, expanded, extraction, features, filters, incremental, joins, lexical, linked, parsing, primitives, profiles, records, rollups, rules, search, streams  # noqa: F401

    return FOUND, SQL
