"""Trends over a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_trend(
    stream: DataFrame,
    time_col: str,
    width: str = "1 hour",
    delay: str = "1 hour",
    groups: list[str] | None = None,
) -> DataFrame:
    """Rows per time window and group; a window is final once the watermark passes it."""
    # Windows and watermarks of a stream want timestamps with a zone.
    timed = stream.withColumn("__t", F.col(time_col).cast("timestamp"))
    return (
        timed.withWatermark("__t", delay)
        .groupBy(F.window("__t", width).alias("w"), *(groups or []))
        .agg(
            F.count(F.lit(1)).alias("sequential_count"),
            F.min("__t").alias("period_start"),
            F.max("__t").alias("period_end"),
        )
        .select(
            F.col("w.start").alias("time_period"),
            *(groups or []),
            "sequential_count",
            "period_start",
            "period_end",
        )
    )


def write_available(result: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all input present and append every changed window to ``path``.

    Each micro-batch adds what it changed, with its number, so the last windows
    of a finished input are there as well. A batch that is repeated after a
    failure replaces its own folder.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        result.writeStream.foreachBatch(add)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_trend(spark: SparkSession, result: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The newest state of every window that ``write_available`` has written."""
    schema = T.StructType([*result.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(path)
    values = [c for c in result.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*").select(*result.columns)
