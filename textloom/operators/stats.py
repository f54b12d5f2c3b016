"""Descriptive statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.ranks import ROW_BITS
from textloom.operators.schema import col, logical_type
from textloom.session import staged

QUANTILES = (0.25, 0.5, 0.75)
ACCURACY = 10_000


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)).cast("bigint")
    )


def exact_quantiles(df: DataFrame, column: str, quantiles: tuple[float, ...]) -> list:
    """Exact quantiles by nearest rank, as Python values (None without rows).

    Equal values are counted map-side, so a value that many rows share is one
    row; the distinct values are range-sorted once, and running counts inside
    the partitions tell which value each rank falls on.
    """
    counts = (
        df.select(col(column).alias("v"))
        .filter(F.col("v").isNotNull())
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    at = F.monotonically_increasing_id()
    placed = staged(counts.orderBy("v").withColumn("part", F.shiftright(at, ROW_BITS)), "quantiles")
    sizes = placed.groupBy("part").agg(F.sum("n").alias("rows"))
    # One row per partition of the sort.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    total = sizes.agg(F.sum("rows")).first()[0]
    if not total:
        return [None] * len(quantiles)
    ranks = [math.floor(q * (total - 1) + 0.5) + 1 for q in quantiles]
    upto = Window.partitionBy("part").orderBy("v")
    running = placed.join(F.broadcast(bases), "part").select(
        "v", (F.col("base") + F.sum("n").over(upto)).alias("upto")
    )
    found = running.agg(*[F.min(F.when(F.col("upto") >= r, F.col("v"))) for r in ranks]).first()
    return list(found)


def describe(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """One row: count, nulls, mean, spread, extremes and quartiles.

    Numbers come out as doubles, times as ISO texts. Exact quartiles run a few
    jobs at once; ``exact=False`` takes the
    quartiles from a sketch in the same pass.
    """
    data_type = df.schema[column].dataType
    value = col(column)
    temporal = logical_type(data_type) == "datetime"
    numeric = isinstance(data_type, T.NumericType)
    probe = value.cast("timestamp") if temporal else value
    numbers = df.select(
        (F.unix_micros(probe).cast("double") if temporal else value).alias("x"), probe.alias("v")
    )

    def shown(c):
        if temporal:
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
        return c.cast("double") if numeric else c.cast("string")

    aggregates = [
        F.count("v").alias("count"),
        F.count_if(F.col("v").isNull()).alias("null_count"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
    ]
    if temporal or numeric:
        aggregates.append(F.avg("x").alias("mean"))
    if numeric:
        aggregates.append(F.stddev_samp("x").alias("std"))
    if not exact and (temporal or numeric):
        aggregates.append(F.percentile_approx("v", list(QUANTILES), ACCURACY).alias("q"))
    row = numbers.agg(*aggregates)

    empty = F.lit(None).cast("double")
    if temporal:
        mean = shown(F.timestamp_micros(F.col("mean").cast("bigint")))
    else:
        mean = F.col("mean") if numeric else empty
    out = row.select(
        "count",
        "null_count",
        mean.alias("mean"),
        (F.col("std") if numeric else empty).alias("std"),
        shown(F.col("least")).alias("min"),
        *(
            [shown(F.get("q", F.lit(i))).alias(f"q{i}") for i in range(3)]
            if not exact and (temporal or numeric)
            else []
        ),
        shown(F.col("most")).alias("max"),
    )
    names = ["percentile_25", "median", "percentile_75"]
    if temporal or numeric:
        if exact:
            ordered = F.unix_micros("v") if temporal else F.col("v")
            found = exact_quantiles(numbers.select(ordered.alias("v")), "v", QUANTILES)
            for i, value in enumerate(found):
                point = F.lit(value).cast("bigint" if temporal else data_type)
                point = F.timestamp_micros(point) if temporal else point
                out = out.withColumn(f"q{i}", shown(point))
    else:
        out = out.withColumns({f"q{i}": F.lit(None).cast("string") for i in range(3)})
    return out.select(
        "count",
        "null_count",
        "mean",
        "std",
        "min",
        *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)],
        "max",
    )
