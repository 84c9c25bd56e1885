"""Queries by name, each with SQL that says the same where there is such."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import frame, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Named texts that several oracles build on.
SHARED: dict[str, str] = {}


class Views:
    """The views and tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register a function of Views as a query."""

    def keep(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql, SHARED)
        return build

    return keep
