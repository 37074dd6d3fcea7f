"""Collects named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.queries.graph import PRELUDE, Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Doubles are compared to six places.  The nudge, far above the error of a sum and far below the last
# place, sends an exact tie the same way in both engines.
NUDGE = 1e-9


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for name in columns:
        df = df.withColumn(name, F.round(F.col(name) + F.lit(NUDGE), 6))
    return df


def query(sql: str | None = None) -> Callable[[Callable[[Graph], DataFrame]], Callable[[Graph], DataFrame]]:
    """Register a function of the graph under its own name; ``sql`` continues the prelude."""

    def register(build: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        name = build.__name__
        QUERIES[name] = lambda spark, folder: build(Graph(spark, folder))
        if sql is not None:
            ORACLES[name] = PRELUDE + sql
        return build

    return register


def same_result_as(name: str) -> Callable[[Callable[[Graph], DataFrame]], Callable[[Graph], DataFrame]]:
    """Register a function that must give the rows of the query ``name`` by another way."""

    def register(build: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[build.__name__] = lambda spark, folder: build(Graph(spark, folder))
        ORACLES[build.__name__] = ORACLES[name]
        return build

    return register
