"""Registered queries and their SQL equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldspark.plans.views import VIEWS, spark_view

Query = Callable[["Inputs"], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Tables and derived views of one data folder, by attribute: ``inputs.v_plot``, ``inputs.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        return spark_view(self.spark, self.folder, name)


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    """Puts the views a statement uses in front of it, each after those it needs."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for view in VIEWS:
            if view not in ordered and re.search(rf"\b{view}\b", text):
                need(VIEWS[view].sql())
                if view not in ordered:
                    ordered.append(view)

    need(sql)
    body = sql.strip()
    if not ordered:
        return body
    head = ", ".join(f"{v} AS ({VIEWS[v].sql()})" for v in ordered)
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
