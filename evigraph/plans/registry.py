"""Registry of the runnable queries and of the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEW_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it names, in dependency order."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name, text in VIEW_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", sql):
                visit(text)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS (\n{VIEW_SQL[n]}\n)" for n in needed)
    if body.lstrip().upper().startswith("WITH "):
        rest = body.lstrip()[5:].lstrip()
        recursive = rest.upper().startswith("RECURSIVE ")
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{rest[10:] if recursive else rest}"
    return f"WITH {ctes}\n{body}"


def query(key: str, sql: str | None = None):
    """Register ``fn(Tables) -> DataFrame`` under ``key`` with its checking SQL."""

    def deco(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = with_views(sql.strip())
        return fn

    return deco
