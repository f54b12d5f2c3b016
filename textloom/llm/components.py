"""Connected components of a link table, as rounds of joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import Scratch

ROWS_PER_FILE = 50_000  # of the tables written between rounds


def components(scratch: Scratch, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has a link; the root is its component's smallest node.

    Alternates "every larger neighbour to my smallest" with "every smaller
    neighbour to my smallest" until nothing moves, which takes about the
    logarithm of the longest chain. A node with very many links is only ever
    aggregated map-side and joined, and such a join is split when it is skewed.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = links.select(high.alias("u"), low.alias("v")).filter("u <> v").distinct()
    edges = scratch.table(edges, "links")
    state = _fingerprint(edges)
    # A round never has more rows than twice the links; many tiny files would cost more than they.
    files = max(1, math.ceil(2 * state[0] / ROWS_PER_FILE))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = _to_smallest(scratch, both, files).filter("w > m").select(
            F.col("w").alias("u"), F.col("m").alias("v")
        )
        edges = scratch.table(edges.distinct().coalesce(files), "large-star")
        moved = _to_smallest(scratch, edges, files)
        edges = moved.select(F.col("w").alias("u"), F.col("m").alias("v")).unionByName(
            moved.select("u", F.col("m").alias("v"))
        )
        edges = scratch.table(edges.filter("u > v").distinct().coalesce(files), "small-star")
        before, state = state, _fingerprint(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _to_smallest(scratch: Scratch, edges: DataFrame, files: int) -> DataFrame:
    """Every edge ``u, w`` with ``m``, the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m")).coalesce(files)
    least = scratch.table(least, "least")
    return edges.withColumnRenamed("v", "w").join(least, "u")


def _fingerprint(edges: DataFrame) -> tuple:
    wide = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(wide)).first())
