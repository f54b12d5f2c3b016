"""Topics over a stream of vectors: centres that every micro-batch moves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.topics import TOPIC

STATE = f"{TOPIC} bigint, centroid array<double>, size bigint"


def _vector(vector_col: str) -> Column:
    """The vector as doubles, null where it has no entries or one that is no finite number."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.when((F.size(v) > 0) & finite, v)


def nearest_topic(vector: Column, centres: list[tuple[int, list[float]]]) -> Column:
    """The topic of the nearest centre (smaller number on ties), null for a null vector.

    Every task gets the centres: as many as topics were asked for.
    """
    centres = sorted(centres)
    names = np.array([t for t, _ in centres], np.int64)
    places = np.array([c for _, c in centres], np.float64)
    own = (places**2).sum(axis=1)

    @F.pandas_udf("bigint")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            out = pd.Series([None] * len(column), dtype="Int64")
            known = np.flatnonzero(column.notna().to_numpy())
            for part in np.array_split(known, len(known) // 4096 + 1):
                if len(part):
                    x = np.stack(column.iloc[part].to_list())
                    out.iloc[part] = names[(own - 2 * x @ places.T).argmin(axis=1)]
            yield out

    return nearest(vector)


def read_topics(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """``TOPIC_topic, centroid, size`` as the last micro-batch (below ``before``) left them."""
    versions = spark.read.schema(f"{STATE}, batch bigint").parquet(folder)
    if before is not None:
        versions = versions.filter(F.col("batch") < before)
    last = versions.agg(F.max("batch")).first()[0]
    return versions.filter(F.col("batch") == F.lit(last)).drop("batch")


def _first_vectors(rows: DataFrame, wanted: int, taken: list[list[float]]) -> list[list[float]]:
    """Different vectors, in the order of the least hash of their ids, none of them ``taken``."""
    order = rows.groupBy("v").agg(F.min(F.md5(F.col("id").cast("string"))).alias("h")).orderBy("h", "v")
    found = [r["v"] for r in order.limit(wanted + len(taken)).collect()]
    return [v for v in found if v not in taken][:wanted]


def update_topics(
    batch: DataFrame, vector_col: str, id_col: str, folder: str, clusters: int, number: int
) -> None:
    """Move the centres in ``folder`` by the rows of micro-batch ``number``.

    Every row goes to the centre that was nearest before the batch; a centre is
    the mean of all rows it ever got. Topics that are missing start at vectors of the
    batch. The state is one row per topic and version, and a batch that is repeated
    starts from the version before it, so its rows count once.
    """
    spark = batch.sparkSession
    rows = batch.select(F.col(id_col).alias("id"), _vector(vector_col).alias("v")).filter("v IS NOT NULL")
    state = {r[TOPIC]: (r["centroid"], r["size"]) for r in read_topics(spark, folder, number).collect()}
    if len(state) < clusters:
        free = [t for t in range(clusters) if t not in state]
        fresh = _first_vectors(rows, len(free), [c for c, _ in state.values()])
        state.update({t: (v, 0) for t, v in zip(free, fresh, strict=False)})
    if state:
        place = nearest_topic(F.col("v"), [(t, c) for t, (c, _) in state.items()])
        moved = (
            rows.select(place.alias(TOPIC), array_to_vector("v").alias("v"))
            .groupBy(TOPIC)
            .agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("m"), F.count(F.lit(1)).alias("n"))
        )
        for r in moved.collect():  # a row per topic
            centre, size = state[r[TOPIC]]
            mean = np.array(centre) + (np.array(r["m"]) - np.array(centre)) * (r["n"] / (size + r["n"]))
            state[r[TOPIC]] = (mean.tolist(), size + r["n"])
    table = spark.createDataFrame([(t, c, n) for t, (c, n) in sorted(state.items())], STATE)
    table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={number}")


def stream_topics(
    stream: DataFrame,
    vector_col: str,
    id_col: str,
    folder: str,
    checkpoint: str,
    clusters: int,
    seeds: DataFrame | None = None,
) -> None:
    """Run a stream of vectors over all input present and keep the centres in ``folder``.

    ``seeds`` gives first centres as ``TOPIC_topic, centroid``, such as those of a
    batch run (``operators.topics.centroids``); without it they are the first
    different vectors in the order of the hash of their ids. Seeds weigh nothing: the
    first rows of a topic replace its seed. Vectors that are null, empty or hold an
    entry that is no finite number take no part; all others have one length.

    However the rows fall into batches, the sizes add up to the rows and the centres,
    weighted by them, to the mean of all rows. The centres themselves are the same for
    any batches as long as no row changes its nearest centre on the way.
    """
    if clusters < 1:
        raise ValueError("at least one cluster")
    spark = stream.sparkSession
    first = spark.createDataFrame([], STATE)
    if seeds is not None:
        first = seeds.select(
            F.col(TOPIC).cast("bigint").alias(TOPIC), F.col("centroid").cast("array<double>").alias("centroid"),
            F.lit(0).cast("bigint").alias("size"),
        )
    first.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch=-1")
    query = (
        stream.writeStream.foreachBatch(
            lambda batch, number: update_topics(batch, vector_col, id_col, folder, clusters, number)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def assign_nearest(df: DataFrame, vector_col: str, centres: DataFrame) -> DataFrame:
    """``df`` with TOPIC_topic, the topic of the nearest centre; null for an unusable vector."""
    places = [(r[TOPIC], r["centroid"]) for r in centres.collect()]
    if not places:
        return df.withColumn(TOPIC, F.lit(None).cast("bigint"))
    return df.withColumn(TOPIC, nearest_topic(_vector(vector_col), places))
