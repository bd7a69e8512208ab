"""A query is a Spark plan over the given tables plus, where SQL can say the same, an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tokenmill.sources.readers import spread


TEXT_TABLES = ("documents", "pages", "conversations")


class Tables:
    """Lazy access to the parquet tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in TEXT_TABLES else df


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.plan(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under `name`, with its SQL twin if there is one."""

    def register(plan: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, plan, sql)
        return plan

    return register
