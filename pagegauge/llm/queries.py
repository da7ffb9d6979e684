"""The operators of this subpackage over the given tables, and the SQL twins of those SQL can state."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import pagegauge.llm
from pagegauge.llm.base import ready

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(ready(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


for _module in pkgutil.iter_modules(pagegauge.llm.__path__):
    if _module.name.startswith("q_"):
        importlib.import_module(f"pagegauge.llm.{_module.name}")
