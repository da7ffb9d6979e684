"""The named queries: each a DataFrame builder over the given tables, most with an SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from pagegauge.session import prepare

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


@dataclass
class Tables:
    """The given tables of one folder, each read once per plan."""

    spark: SparkSession
    folder: str
    _read: dict[str, DataFrame] = field(default_factory=dict)
    #: The clocked events, if a query that reads them many times has written them.
    clock: DataFrame | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """A named step the SQL twins may read (``fx_…``); added to them as a common table expression."""
    VIEWS[name] = sql


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in re.findall(r"\bfx_\w+", sql):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def compose(sql: str) -> str:
    steps = [f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in _needed(sql, [])]
    body = sql.strip()
    if not steps:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(steps) + ", " + body[len("WITH RECURSIVE") :]
    if body.upper().startswith("WITH"):
        return "WITH " + ", ".join(steps) + ", " + body[len("WITH") :]
    return "WITH " + ", ".join(steps) + " " + body


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build):
        return lambda spark, folder: build(Tables(prepare(spark), folder))

    return {name: bound(build) for name, build in QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: compose(sql) for name, sql in ORACLES.items()}
