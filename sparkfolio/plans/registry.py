"""Registered queries over the engine's operators, with their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.corpus import Corpus

FLAGSHIP = "institution_ranking"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Corpus under its name."""

    def add(f: Callable[[Corpus], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Corpus(spark, folder))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


for _name in ("papers", "graph", "analysis", "retrieval", "events", "answers"):
    importlib.import_module(f"sparkfolio.plans.{_name}")
