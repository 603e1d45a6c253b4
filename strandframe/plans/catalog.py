"""Registry of queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import inputs


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[["Tables"], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


class Tables:
    """The driver tables of one folder; derived inputs come from ``inputs``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in inputs.DERIVED:
            return inputs.DERIVED[name].frame(self)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register a query; ``uses`` names the derived inputs put before ``sql`` as common table expressions."""

    def add(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        text = sql
        if text is not None and uses:
            text = inputs.with_clause(uses.split()) + text.lstrip()
        REGISTRY[name] = Query(name, build, text)
        return build

    return add


def run(name: str):
    def call(spark: SparkSession, folder: str) -> DataFrame:
        return REGISTRY[name].build(Tables(spark, folder))

    return call
