"""Ready-made queries over the given tables, each with its SQL counterpart.

A query is `(spark, folder) -> DataFrame`; its SQL runs on any engine that has
the same tables as views and is used to check the result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        REGISTRY[name] = Query(run, sql)
        return run

    return add


def load_all() -> dict[str, Query]:
    from corpusloom.queries import articles, conversations, scores, search, text, training, web  # noqa: F401

    return REGISTRY
