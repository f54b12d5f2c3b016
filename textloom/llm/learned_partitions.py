"""Nearest neighbours by learned partitions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.scratch import Scratch

SAMPLE = 8192  # distinct vectors on which partitions and classifier are fitted
CELL = 200  # distinct vectors per partition, as long as the sample can tell them apart
PER_PART = 64  # sampled vectors per partition at least
GRAPH = 10  # neighbours of a vector in the graph
PROBED = 0.8  # of all partitions, for each query; less where vectors cluster
BLOCK = 4096  # vectors compared with a block of queries at a time


@dataclass(frozen=True)
class Router:
    """A classifier with one hidden layer: the probabilities of the partitions."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(_unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """The k rows of ``of`` with the largest inner product, without the row itself."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        scores = x[a : a + 512] @ of.T
        scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
        out[a : a + 512] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(graph: np.ndarray, x: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A partition of the neighbour graph into parts of near equal size that cuts few edges.

    Starts from the nearest of ``parts`` spread-out vectors, as far as there is
    room; then each vector moves to the part of most of its neighbours, if that
    has room, until hardly any moves.
    """
    rng = np.random.default_rng(seed)
    n = len(x)
    room = math.ceil(1.05 * n / parts)
    seeds = [int(rng.integers(n))]
    close = x @ x[seeds[0]]
    while len(seeds) < parts:
        far = np.maximum(1 - close, 0) ** 2 + 1e-12
        seeds.append(int(rng.choice(n, p=far / far.sum())))
        close = np.maximum(close, x @ x[seeds[-1]])
    near = np.argsort(-(x @ x[seeds].T), axis=1)
    part = np.full(n, -1)
    size = np.zeros(parts, np.int64)
    for v in rng.permutation(n):
        p = next(p for p in near[v] if size[p] < room)
        part[v] = p
        size[p] += 1
    around: list[list[int]] = [list(row) for row in graph]
    for v, row in enumerate(graph):
        for u in row:
            around[u].append(v)
    links = [np.array(a) for a in around]
    for _ in range(12):
        moved = 0
        for v in rng.permutation(n):
            votes = np.bincount(part[links[v]], minlength=parts)
            votes[size >= room] = np.minimum(votes[size >= room], -1)
            here = part[v]
            votes[here] = np.count_nonzero(part[links[v]] == here)
            best = int(votes.argmax())
            if votes[best] > votes[here]:
                size[here] -= 1
                size[best] += 1
                part[v] = best
                moved += 1
        if moved < n // 200:
            break
    return part


def fit(sample: np.ndarray, parts: int, k: int, seed: int = 7) -> Router:
    """Partition the sample's neighbour graph and learn where a vector's neighbours are."""
    x = _unit(sample)
    dim = x.shape[1]
    rng = np.random.default_rng(seed)
    if parts == 1 or len(x) <= GRAPH:
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, max(parts, 1))), np.zeros(max(parts, 1)))
    part = balanced_partition(_nearest(x, x, GRAPH), x, parts, seed)
    # A vector's target: the parts of those that are nearest by inner product, and its own.
    wide = min(k, len(x) - 1)
    near = _nearest(sample, sample, wide)
    target = np.zeros((len(x), parts))
    for j in range(wide):
        np.add.at(target, (np.arange(len(x)), part[near[:, j]]), 0.5 / wide)
    target[np.arange(len(x)), part] += 0.5
    hidden = 128
    weights = [
        rng.normal(0, math.sqrt(2 / dim), (dim, hidden)), np.zeros(hidden),
        rng.normal(0, math.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts),
    ]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    t = 0
    rate = 3e-3
    for epoch in range(40):
        if epoch in (20, 32):
            rate /= 4
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            pick = order[a : a + 256]
            h = np.maximum(x[pick] @ weights[0] + weights[1], 0)
            z = h @ weights[2] + weights[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            slope = (z / z.sum(axis=1, keepdims=True) - target[pick]) / len(pick)
            back = (slope @ weights[2].T) * (h > 0)
            grads = [x[pick].T @ back, back.sum(0), h.T @ slope, slope.sum(0)]
            t += 1
            for w, g, m, s in zip(weights, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Router(*weights)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _rerank(table: pa.Table, dim: int, parts: int, k: int) -> pa.Table:
    """The k best vectors of a block for each of its queries, by exact inner products.

    A query sees the vectors of the partitions it was sent to; vectors as good as
    the last one stay.
    """
    role = np.asarray(table.column("query"))
    keys = np.asarray(table.column("key"))
    vectors = _matrix(table.column("vector"), dim)
    queries, base = np.flatnonzero(role), np.flatnonzero(~role)
    cells = table.column("cells").to_pylist()
    home = np.array([cells[i][0] for i in base], np.int64)
    x = vectors[base]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(queries) if len(base) else 0, 128):
        pick = queries[a : a + 128]
        sent = np.zeros((len(pick), parts), bool)
        for row, i in enumerate(pick):
            sent[row, cells[i]] = True
        rough = np.where(sent[:, home], vectors[pick] @ x.T, -np.inf)
        # A few more than k, as rounding differs between the two ways to multiply.
        wide = min(k + 8, len(base))
        top = np.argpartition(-rough, wide - 1, axis=1)[:, :wide]
        exact = (vectors[pick][:, None, :] * x[top]).sum(axis=2)
        exact[~np.isfinite(np.take_along_axis(rough, top, 1))] = -np.inf
        last = -np.sort(-exact, axis=1)[:, min(k, wide) - 1]
        row, at = np.nonzero(np.isfinite(exact) & (exact >= last[:, None]))
        out.append((keys[pick][row], keys[base][top[row, at]], exact[row, at]))
    kinds = (np.int64, np.int64, np.float64)
    q, found, score = (
        np.concatenate([o[i] for o in out]) if out else np.empty(0, kind)
        for i, kind in enumerate(kinds)
    )
    return pa.table({"q": q, "x": found, "score": score})


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    probed: float = PROBED,
    sample: int = SAMPLE,
    cell: int = CELL,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, <id>, score``: the k rows of largest inner product found for each query.

    The query's own id is no candidate; ties go to the smaller id. Vectors that
    are null or zero or hold a null, NaN or infinite component take no part, nor
    do those of another length than the most frequent one (of equally frequent
    ones, the longest).

    Equal vectors are one: of their ids the k + 1 smallest are kept, all that
    any query can return. The index is fitted on at most ``sample`` distinct
    vectors, picked by hash: their neighbour graph is cut into balanced
    partitions and a small network learns which partitions hold a vector's
    neighbours. It then places every vector, and sends each query to the
    ``probed`` share of partitions it finds most probable, or to more until they
    hold 4 k vectors. There exact products, in double precision, decide.

    Small partitions are packed into blocks of up to ``block`` vectors, large
    ones are split into such; a block meets about ``block`` queries at a time. Fewer than k candidates give fewer rows;
    an empty table gives none. Rows with equal ids and vectors are one; an id on
    several vectors is a candidate with each and, as a query, ranks each
    vector's answers on their own. Null ids take no part. Other columns are
    ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    e = F.col("vector")
    sound = F.forall(
        e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    ) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
    ).filter(F.col("id").isNotNull() & e.isNotNull() & sound)
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d"))
    head = common.limit(1).collect()
    dim = head[0]["d"] if head else 1
    rows = rows.filter(F.size("vector") == dim)
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    ids = rows.select("vector", "id").distinct().withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    base = ids.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    base = scratch.table(base.withColumn("key", F.monotonically_increasing_id()), "distinct")
    asked = rows.filter("query").select("vector", F.col("id").alias("query_id")).distinct()
    asked = scratch.table(asked.join(base.select("vector", "key"), "vector").drop("vector"), "asked")
    total = base.count()
    picked = base.orderBy(F.xxhash64("vector"), "vector").limit(sample).select("vector").collect()
    parts = max(1, min(total // cell, len(picked) // PER_PART))
    fitted = np.array([r["vector"] for r in picked], np.float64).reshape(-1, dim)
    router = fit(fitted, parts, k)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = router.scores(_matrix(batch.column("vector"), dim)).argmax(axis=1)
                yield batch.append_column("cell", pa.array(found, pa.int32()))

    element = base.schema["vector"].dataType.simpleString()
    placed = scratch.table(
        base.select("key", "vector").mapInArrow(place, f"key long, vector {element}, cell int"), "placed"
    )
    held = np.zeros(parts, np.int64)
    for r in placed.groupBy("cell").count().collect():  # one row per partition
        held[r["cell"]] = r["count"]
    least = max(1, math.ceil(probed * parts))
    # Partitions in a row share a block as far as there is room.
    block_of = np.zeros(parts, np.int64)
    for c in range(1, parts):
        same = np.flatnonzero(block_of[:c] == block_of[c - 1])
        block_of[c] = block_of[c - 1] + (held[same].sum() + held[c] > block)
    blocks = int(block_of[-1]) + 1

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("block", pa.int32()), ("cells", pa.list_(pa.int32()))]))
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-router.scores(_matrix(batch.column("vector"), dim)), axis=1)
            enough = (np.cumsum(held[order], axis=1) >= 4 * k + 1).argmax(axis=1) + 1
            full = held[order].sum(axis=1) < 4 * k + 1
            take = np.where(full, parts, np.maximum(enough, least))
            sent = []
            for row, n in zip(order, take, strict=True):
                cells: dict[int, list[int]] = {}
                for c in row[:n].tolist():
                    cells.setdefault(int(block_of[c]), []).append(c)
                sent.append([{"block": b, "cells": c} for b, c in cells.items()])
            yield batch.append_column("sent", pa.array(sent, kind))

    sought = base.join(asked.select("key").distinct(), "key", "left_semi").select("key", "vector")
    routed = scratch.table(
        sought.mapInArrow(
            route, f"key long, vector {element}, sent array<struct<block:int,cells:array<int>>>"
        ),
        "routed",
    ).select("key", "vector", F.explode("sent").alias("s"))
    routed = routed.select("key", "vector", "s.block", "s.cells")
    size, visits = np.bincount(block_of, weights=held, minlength=blocks), np.zeros(blocks, np.int64)
    for r in routed.groupBy("block").count().collect():  # one row per block of partitions
        visits[r["block"]] = r["count"]
    grid = spark.createDataFrame(
        [
            (c, int(b), math.ceil(size[b] / block) or 1, math.ceil(visits[b] / block) or 1)
            for c, b in enumerate(block_of)
        ],
        "cell int, block int, subs int, qsubs int",
    )  # one row per partition
    mine = F.pmod(F.xxhash64("key"), F.col("subs")).cast("int")
    theirs = F.pmod(F.xxhash64("key"), F.col("qsubs")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(F.broadcast(grid), "cell").select(
        "key", "vector", F.lit(False).alias("query"), F.array("cell").alias("cells"), "block",
        mine.alias("sub"), every("qsubs").alias("qsub"),
    )
    per_block = F.broadcast(grid.select("block", "subs", "qsubs").distinct())
    right = routed.join(per_block, "block").select(
        "key", "vector", F.lit(True).alias("query"), "cells", "block", every("subs").alias("sub"),
        theirs.alias("qsub"),
    )
    met = left.unionByName(right).groupBy("block", "sub", "qsub")
    found = met.applyInArrow(lambda t: _rerank(t, dim, parts, k + 1), "q long, x long, score double")
    named = found.join(base.select(F.col("key").alias("x"), "ids"), "x")
    near = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0], "x")
    best = named.withColumn("nth", F.row_number().over(near)).filter(F.col("nth") <= k + 1)
    answers = best.select("q", "score", F.explode("ids").alias("id"))
    cut = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    answers = answers.withColumn("nth", F.row_number().over(cut)).filter(F.col("nth") <= k + 1)
    answers = scratch.table(answers.select("q", "score", "id"), "answers")
    out = asked.join(answers, asked["key"] == answers["q"]).filter("id <> query_id")
    last = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "id")
    out = out.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return scratch.finish(out.select("query_id", "rank", F.col("id").alias(id_col), "score"))
