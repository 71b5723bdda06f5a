"""Registered queries: each an operator over views of the shared tables, with the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, and never minus zero, so that other engines' sums agree."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = "", places: int = 6):
    """Register a function (spark, dir) -> DataFrame. sql: DuckDB SQL over the views; doubles: its columns to be rounded."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), places)
        if sql is not None:
            ORACLES[name] = with_views(sql, doubles.split(), places)
        return f

    return register


def with_views(sql: str, doubles: list[str], places: int) -> str:
    from .views import SQL

    used: list[str] = []

    def need(text: str) -> None:
        for v in SQL:
            if re.search(rf"\b{v}\b", text) and v not in used:
                need(SQL[v])
                used.append(v)

    need(sql)
    ctes = ", ".join(f"{v} as materialized ({SQL[v]})" for v in used)
    rounds = ", ".join(f"round(cast({c} as double), {places}) + 0.0 as {c}" for c in doubles)
    head = re.match(r"\s*with( recursive)?\b", sql, re.I)
    body = sql if not ctes else f"with{head[1] or ''} {ctes}, {sql[head.end():]}" if head else f"with {ctes} {sql}"
    return f"select * {f'replace ({rounds})' if rounds else ''} from ({body})"
