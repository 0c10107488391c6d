"""Collects queries with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str, each: int = 100_000) -> DataFrame:
    """rows dealt by keys to as many tasks as hold `each` of them, so that a task's sorts and tables stay as large however many rows there are. Counts the rows."""
    return rows.repartition(rows.count() // each + 1, *keys)


def meet_on_part_of_keys(spark: SparkSession) -> None:
    """Lets tables that are dealt alike by some of a join's keys meet without another shuffle, until the next query is asked for."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where that is unset (tests), in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_streams"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
