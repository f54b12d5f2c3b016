"""Topics over embedding vectors, their words, labels and maps."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.stopwords import default_stop_words
from textloom.operators.keyness import without_stop_words
from textloom.operators.tokens import find_derived, token_words

TOPIC, MEANING = "TOPIC_topic", "TOPIC_topic_meaning"
OUTLIER = -1
DIMENSIONS = 5
MAX_TOPICS = 5000  # tables of one row per topic may pass through the driver


def topic_size(rows: int, mode: str, value: int) -> int:
    """Smallest cluster that counts as a topic."""
    by_target = max(2, rows // (int(value) * 10))
    if mode == "target":
        return by_target
    if mode == "min":
        return max(2, int(value))
    if mode == "exact":
        return max(5, int(0.75 * by_target))
    raise ValueError(f"unknown size mode {mode!r}")


def default_clusters(rows: int) -> int:
    return max(10, min(200, int(math.sqrt(rows / 2))))


def words_to_compute(shown: int | None) -> int:
    return max(50, 2 * (shown or 0))


def assign_topics(
    df: DataFrame,
    vector_col: str,
    clusters: int | None = None,
    seed: int = 42,
    dimensions: int = DIMENSIONS,
    bisecting: bool = False,
) -> DataFrame:
    """Add TOPIC_topic: PCA to a few dimensions, then k-means."""
    k = clusters if clusters and clusters > 0 else default_clusters(df.count())
    if k > MAX_TOPICS:
        raise ValueError(f"at most {MAX_TOPICS} clusters")
    vectors = df.withColumn("__v", array_to_vector(F.col(vector_col).cast("array<double>")))
    reduced = PCA(k=dimensions, inputCol="__v", outputCol="__p").fit(vectors).transform(vectors)
    method = BisectingKMeans if bisecting else KMeans
    model = method(k=k, seed=seed, featuresCol="__p", predictionCol=TOPIC).fit(reduced)
    return model.transform(reduced).withColumn(TOPIC, F.col(TOPIC).cast("bigint")).drop("__v", "__p")


def mark_outliers(assigned: DataFrame, least: int) -> DataFrame:
    """Clusters of fewer than ``least`` rows become the outlier topic."""
    sizes = assigned.groupBy(TOPIC).agg(F.count(F.lit(1)).alias("__n"))
    small = sizes.filter(F.col("__n") < least).select(TOPIC, F.lit(True).alias("__small"))
    return (
        assigned.join(small, TOPIC, "left")
        .withColumn(TOPIC, F.when(F.col("__small"), F.lit(OUTLIER)).otherwise(F.col(TOPIC)))
        .drop("__small")
        .select(*assigned.columns)
    )


def mark_small(assigned: DataFrame, mode: str, value: int) -> DataFrame:
    """Clusters below the size rule become the outlier topic; the rows are counted first."""
    return mark_outliers(assigned, topic_size(assigned.count(), mode, value))


def label_text(df: DataFrame, text_col: str, model: str | None = None) -> Column:
    """Text used for topic words: the tokens where a token column exists."""
    name = find_derived(df, text_col, model=model)
    if name is None:
        return F.coalesce(F.col(text_col), F.lit(""))
    return F.array_join(F.transform(F.col(f"`{name}`"), lambda t: t["token"]), " ")


def topic_words(
    df: DataFrame,
    topic_col: str,
    text: Column,
    language: str = "en",
    top_n: int = 50,
) -> DataFrame:
    """Best words per topic by class-based TF-IDF: topic, word, score, rank.

    English texts lose stop words and one-letter words, others nothing.
    """
    rows = df.select(
        F.col(topic_col).alias("topic"), F.explode(token_words(text)).alias("token")
    ).filter(F.col("topic").isNotNull())
    counts = rows.groupBy("topic", "token").agg(F.count(F.lit(1)).alias("n"))
    if language == "en":
        counts = without_stop_words(counts.filter(F.length("token") > 1), default_stop_words("en"))
    sizes = counts.groupBy("topic").agg(F.sum("n").alias("size"))
    mean_size = sizes.agg(F.avg("size")).scalar()
    # A word has at most one row per topic, so these windows stay small.
    everywhere = F.sum("n").over(Window.partitionBy("token"))
    scored = (
        counts.withColumn("everywhere", everywhere)
        .join(sizes, "topic")
        .withColumn(
            "score", F.col("n") / F.col("size") * F.ln(1 + mean_size / F.col("everywhere"))
        )
    )
    best = Window.partitionBy("topic").orderBy(F.desc("score"), F.asc("token"))
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top_n)
        .select("topic", F.col("token").alias("word"), "score", "rank")
    )


def topic_meanings(words: DataFrame, shown: int = 5) -> DataFrame:
    """Per topic the list of its best words; the outlier topic has none."""
    return (
        words.filter((F.col("rank") <= shown) & (F.col("topic") != F.lit(OUTLIER)))
        .groupBy(F.col("topic").alias(TOPIC))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("w"))
        .select(TOPIC, F.col("w.word").alias(MEANING))
    )


def topic_label(meaning: Column, topic: Column, shown: int = 5) -> Column:
    joined = F.array_join(F.slice(meaning, 1, shown), " | ")
    fallback = F.concat(F.lit("Topic "), topic.cast("string"))
    return F.when(F.size(meaning) > 0, joined).otherwise(fallback)


def topic_counts(assigned: DataFrame, corpus_col: str, topic_col: str = TOPIC) -> DataFrame:
    return assigned.groupBy(corpus_col, topic_col).agg(F.count(F.lit(1)).alias("size"))


def topic_table(
    assigned: DataFrame,
    meanings: DataFrame,
    corpora: list[str],
    corpus_col: str,
    topic_col: str = TOPIC,
    shown: int = 5,
) -> DataFrame:
    """One row per topic: label, size per corpus in the given order, total size."""
    per_corpus = [F.count_if(F.col(corpus_col) == c) for c in corpora]
    sizes = (
        assigned.filter(F.col(topic_col) != F.lit(OUTLIER))
        .groupBy(F.col(topic_col).alias(TOPIC))
        .agg(F.array(*per_corpus).alias("size"), F.count(F.lit(1)).alias("total_size"))
    )
    return sizes.join(meanings, TOPIC, "left").select(
        F.col(TOPIC).alias("id"),
        topic_label(
            F.coalesce(F.col(MEANING), F.array().cast("array<string>")), F.col(TOPIC), shown
        ).alias("label"),
        F.col(MEANING).alias("representative_words"),
        "size",
        "total_size",
    )


def assignments(assigned: DataFrame, id_col: str) -> DataFrame:
    return assigned.select(F.col(id_col), F.col(TOPIC).cast("bigint").alias(TOPIC))


def centroids(assigned: DataFrame, vector_col: str) -> DataFrame:
    """Mean vector and size of every topic but the outliers."""
    vector = array_to_vector(F.col(vector_col).cast("array<double>"))
    return (
        assigned.filter(F.col(TOPIC) != F.lit(OUTLIER))
        .groupBy(TOPIC)
        .agg(Summarizer.mean(vector).alias("m"), F.count(F.lit(1)).alias("size"))
        .select(TOPIC, vector_to_array("m").alias("centroid"), "size")
    )


def _small_rows(table: DataFrame) -> list:
    rows = table.orderBy(TOPIC).limit(MAX_TOPICS + 1).collect()
    if len(rows) > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics")
    return rows


def topic_map(center_table: DataFrame) -> DataFrame:
    """Two coordinates per topic: the main axes of the centroids, their mean at the origin.

    The largest entry of every axis is positive.
    """
    topics = center_table.select(TOPIC, array_to_vector("centroid").alias("__v"))
    if topics.count() <= 1:
        return topics.select(TOPIC, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    wide = center_table.select(F.size("centroid")).first()[0]
    model = PCA(k=min(2, wide), inputCol="__v", outputCol="__p").fit(topics)
    flat = model.transform(topics).select(TOPIC, vector_to_array("__p").alias("p"))
    axes = flat.select(
        TOPIC, F.get("p", F.lit(0)).alias("x"), F.coalesce(F.get("p", F.lit(1)), F.lit(0.0)).alias("y")
    )
    means = axes.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    moved = axes.crossJoin(means).select(  # one row
        TOPIC, (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y")
    )
    signs = moved.agg(
        F.signum(F.max_by("x", F.abs("x"))).alias("sx"), F.signum(F.max_by("y", F.abs("y"))).alias("sy")
    )
    sign = lambda c: F.when(F.col(c) < 0, -1.0).otherwise(1.0)
    return moved.crossJoin(signs).select(
        TOPIC, (F.col("x") * sign("sx")).alias("x"), (F.col("y") * sign("sy")).alias("y")
    )


def merge_plan(center_table: DataFrame, wanted: int) -> dict[int, int]:
    """Which topic every topic joins when similar ones merge down to ``wanted``.

    The most similar pair by cosine merges first; the smaller id survives.
    """
    rows = _small_rows(center_table)
    if not 2 <= wanted <= len(rows):
        raise ValueError(f"the topic count must be between 2 and {len(rows)}")
    ids = [r[TOPIC] for r in rows]
    sums = np.array([np.array(r["centroid"]) * r["size"] for r in rows])
    target = {t: t for t in ids}
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    # Similarity to later topics; a merge changes one row and one column of it.
    similar = np.where(np.triu(np.ones((len(ids),) * 2, bool), 1), unit @ unit.T, -2.0)
    for _ in range(len(ids) - wanted):
        keep, gone = divmod(int(similar.argmax()), len(ids))
        sums[keep] += sums[gone]
        unit[keep] = sums[keep] / max(np.linalg.norm(sums[keep]), 1e-12)
        target = {t: ids[keep] if v == ids[gone] else v for t, v in target.items()}
        near = unit @ unit[keep]
        later, earlier = similar[keep] > -2, similar[:, keep] > -2
        similar[keep, later] = near[later]
        similar[earlier, keep] = near[earlier]
        similar[gone, :] = similar[:, gone] = -2.0
    return target


def reduce_topics(assigned: DataFrame, vector_col: str, wanted: int) -> DataFrame:
    """Merge similar topics to exactly ``wanted``; outliers stay outliers."""
    plan = merge_plan(centroids(assigned, vector_col), wanted)
    table = assigned.sparkSession.createDataFrame(
        list(plan.items()), f"{TOPIC} bigint, __new bigint"
    )
    return (
        assigned.join(F.broadcast(table), TOPIC, "left")
        .withColumn(TOPIC, F.coalesce("__new", TOPIC))
        .select(*assigned.columns)
    )


def free_name(base: str | None, taken: list[str]) -> str:
    """``base``, or the first of base_1, base_2, ... that is not taken."""
    stem = (base or "").strip() or TOPIC
    name, i = stem, 0
    while name in taken:
        i += 1
        name = f"{stem}_{i}"
    return name


def detach_topics(
    source: DataFrame,
    assigned: DataFrame,
    id_col: str,
    columns: list[str],
    topics: list[int] | None = None,
    topic_name: str | None = None,
) -> DataFrame:
    """Source rows with their topic: chosen columns and topics only."""
    unknown = [c for c in columns if c not in source.columns]
    if not columns or unknown:
        raise ValueError(f"no columns chosen or unknown ones: {unknown}")
    rows = assigned if topics is None else assigned.filter(F.col(TOPIC).isin(topics))
    name = free_name(topic_name, source.columns)
    picked = source.select(F.col(id_col).alias("__id"), *columns)
    chosen = rows.select(F.col(id_col).alias("__id"), F.col(TOPIC).alias("__topic"))
    joined = picked.join(chosen, "__id")
    return joined.select(*columns, F.col("__topic").alias(name))


def detach_meanings(
    meanings: DataFrame,
    assigned: DataFrame,
    topics: list[int] | None = None,
    words: dict[int, list[str]] | None = None,
) -> DataFrame:
    """Meanings of the topics present, with optional words of the user's own."""
    rows = assigned if topics is None else assigned.filter(F.col(TOPIC).isin(topics))
    kept = meanings.join(rows.select(TOPIC).distinct(), TOPIC, "left_semi")
    if not words:
        return kept
    own = meanings.sparkSession.createDataFrame(
        list(words.items()), f"{TOPIC} bigint, __words array<string>"
    )
    joined = kept.join(own, TOPIC, "left")
    return joined.select(TOPIC, F.coalesce("__words", MEANING).alias(MEANING))
