"""Queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.plans.checks.views import SQL_VIEWS

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def check(sql: str | None = None, views: tuple[str, ...] = ("parts", "reports")):
    """Register a query under its function name; `views` are put before the SQL as CTEs."""

    def register(query: Query) -> Query:
        name = query.__name__
        if name in _QUERIES:
            raise ValueError(f"query {name} exists already")
        _QUERIES[name] = query
        if sql is not None:
            body = sql.strip()
            ctes = [f"{view} AS ({SQL_VIEWS[view].strip()})" for view in views]
            if body.upper().startswith("WITH "):
                ctes.append(body[5:])
                _ORACLES[name] = "WITH " + ",\n".join(ctes)
            else:
                _ORACLES[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
        return query

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
