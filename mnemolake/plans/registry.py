"""Queries by name, each with the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.derived import AS_OF, derived, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """t.memories, t.events, ...: derived tables, or base tables read where they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        from ..sources.derived import TABLES

        return derived(self.spark, self.sf_dir, name) if name in TABLES else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers f(tables) under a name; sql may use the derived tables' names and {as_of}."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_tables(sql.replace("{as_of}", f"timestamp '{AS_OF}'"))
        return f

    return add


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")
