"""Registry of named queries: a Spark plan plus, where one exists, an
independent SQL formulation of the same result (the correctness oracle)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    inventory: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, inventory: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, inventory)
        return fn
    return deco
