"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.frames import without

BROADCAST_SOURCES = 10_000
DRAW_RATE = 500.0  # exp(-rate) of one draw stays far from the least double
BLOCK = 1000  # copies numbered at a time


def rates(
    docs: DataFrame, targets: dict[str, float] | None = None, source_col: str = "source",
    total: float | None = None,
) -> DataFrame:
    """``source, n, rate, draws, steps``: copies wanted per document, and how they are drawn.

    A source of weight w gets ``total * w / sum of weights`` rows in the mean;
    ``total`` is the number of documents unless given. Without ``targets`` all
    sources weigh the same, null being one of them; sources that ``targets``
    leaves out get rate 0. A rate above DRAW_RATE is split into ``draws`` equal
    parts; ``steps`` is the distribution function of one part.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    else:
        if not targets or min(targets.values()) < 0 or sum(targets.values()) <= 0:
            raise ValueError("target weights are not negative, and one is positive")
        given = docs.sparkSession.createDataFrame(
            [(s, float(w)) for s, w in targets.items()], "source string, w double"
        )
        weighted = counts.join(given, "source", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    whole = weighted.agg(F.sum("n").alias("rows"), F.sum("w").alias("weight"))
    size = F.col("rows").cast("double") if total is None else F.lit(float(total))
    rated = weighted.crossJoin(F.broadcast(whole)).select(  # one row
        "source", "n",
        F.coalesce(F.try_divide(size * F.col("w") / F.col("n"), "weight"), F.lit(0.0)).alias("rate"),
    )
    draws = F.greatest(F.ceil(F.col("rate") / DRAW_RATE).cast("int"), F.lit(1))
    rated = rated.withColumn("draws", draws).withColumn("part", F.col("rate") / F.col("draws"))
    # The distribution function up to where its rest is far below the grain of the draw.
    last = F.ceil(F.col("part") + 12 * F.sqrt("part") + 40).cast("int")
    none = F.array().cast("array<double>")
    start = F.struct(
        F.exp(-F.col("part")).alias("p"), F.lit(0.0).alias("c"), none.alias("steps")
    )

    def step(state, k):
        c = state["c"] + state["p"]
        return F.struct(
            (state["p"] * F.col("part") / k).alias("p"), c.alias("c"),
            F.array_append(state["steps"], c).alias("steps"),
        )

    steps = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["steps"])
    return rated.withColumn("steps", steps).drop("part")


def draw(id_col: str, seed: int, salt: str | F.Column = "") -> F.Column:
    """A number in (0, 1) that depends on the id, the seed and the salt alone."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    key = F.concat_ws(":", F.concat(F.lit(str(seed)), salt), ident)
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def mix(
    docs: DataFrame,
    targets: dict[str, float] | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    total: float | None = None,
    broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """``docs``, each row ``copies`` times, numbered by ``copy`` from 1, in a global random order.

    The number of copies is the Poisson distribution with the source's rate,
    inverted at a hash of the id: the same id always gets the same number, on
    any partitioning, so a lost task repeats itself. Rows are then range
    partitioned and sorted by ``shuffle_key``, a hash of id and copy. A rate
    above DRAW_RATE, as of a small source in a large corpus, is the sum of
    independent draws of equal parts, each with a salt of its own.

    No row is sampled from a group, so a source that holds a third of all rows
    costs nothing extra. Rates are broadcast if there are at most
    ``broadcast_sources`` sources, else joined by a shuffle. Rows with equal ids
    are drawn alike; rows without an id are drawn as one id. Texts are not read.
    Columns with the names of added ones are replaced.
    """
    docs = without(docs, ("copies", "copy", "shuffle_key"))
    table = rates(docs, targets, source_col, total)
    few = docs.select(source_col).distinct().count() <= broadcast_sources
    side = table.select(
        F.col("source").alias("__source"), F.col("draws").alias("__draws"), F.col("steps").alias("__steps")
    )
    same = F.col(source_col).eqNullSafe(F.col("__source"))
    joined = docs.join(F.broadcast(side) if few else side, same, "left")
    us = F.transform(
        F.sequence(F.lit(1), F.col("__draws")),
        lambda k: draw(id_col, seed, F.when(k == 1, "").otherwise(F.concat(F.lit("-draw"), k.cast("string")))),
    )
    number = F.aggregate(
        us, F.lit(0), lambda n, u: n + F.size(F.filter("__steps", lambda c: c < u))
    )
    # Copies are numbered a block at a time, so that no row holds an array of all its copies.
    blocks = joined.withColumn("copies", number).filter("copies > 0").withColumn(
        "__from", F.explode(F.sequence(F.lit(1), F.col("copies"), F.lit(BLOCK)))
    )
    upto = F.least(F.col("copies"), F.col("__from") + (BLOCK - 1))
    rows = blocks.withColumn("copy", F.explode(F.sequence(F.col("__from"), upto)))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), ident, F.col("copy")))
    mixed = rows.withColumn("shuffle_key", key).select(
        *docs.columns, "copies", "copy", "shuffle_key"
    )
    return mixed.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key", id_col)
