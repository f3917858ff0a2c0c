"""Registry of queries and the table views they read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stopfield.queries.views import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROWS: dict[str, str] = {}

_VIEW = re.compile(r"\bv_\w+\b")


def with_views(body: str) -> str:
    """The statement with a WITH clause for every view it names, views of views first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_VIEW.findall(text)):
            if name in SQL_VIEWS and name not in order:
                visit(SQL_VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(body)
    body = body.strip()
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n].strip()})" for n in order)
    if not ctes:
        return body
    if body[:15].lower() == "with recursive ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].lower() == "with ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, rows: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``rows`` names the inventory rows it covers."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        ROWS[name] = rows
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
