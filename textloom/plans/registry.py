"""Where queries and their SQL are registered."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows if there is one."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Times without a zone are read as UTC, as the SQL does.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, in as many partitions as the session asks for, else as they lie.

    ``spark.textloom.inputPartitions`` is for a session that reads one small
    file, which Spark cannot split; it is unset on a cluster.
    """
    parts = spark.conf.get("spark.textloom.inputPartitions", None)
    docs = table(spark, sf_dir, "documents")
    return docs.repartition(int(parts)) if parts else docs
