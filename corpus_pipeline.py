"""The documents, from raw to mixed and sharded, by five of the operators in ``textloom.llm``.

Near copies are judged here on 5-word shingles at a similarity of 0.8. A row without an id goes by
its text from the second stage to the fourth: it is a copy of rows with the same text, falls with its
own benchmark passages and is drawn by itself.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, near_dup, poisson_mix, slot_shards, toxicity
from textloom.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SHARDS = 24
SEED = 17
USED = ("doc_id", "text", "source")  # the columns that the operators see
REST = "rest"  # all others, as one column

# The classifier, the bounds on sets and the slot map have no SQL form.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _apart(stage: Stage) -> Stage:
    """``stage`` with all columns but the used ones packed into one, so that no name clashes.

    Columns that the stage adds replace those of the same name.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [docs[f"`{c.replace('`', '``')}`"].alias(c) for c in docs.columns if c not in USED]
        packed = docs.select(*USED, F.struct(*(others or [F.lit(None).alias("none")])).alias(REST))
        out = stage(spark, packed, sf_dir)
        added = [c for c in out.columns if c not in (*USED, REST)]
        kept = [c for c in docs.columns if c.lower() not in added]
        back = [F.col(c) if c in USED else F.col(REST).getField(c).alias(c) for c in kept]
        return out.select(*back, *added)

    return run


def _text_key() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__key``: the id or, without one, a 128-bit hash of the text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text-"), _text_key()))
    return docs.withColumn("__key", key)


@_apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


@_apart
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays.

    Ids are numbers there, so a row without one gets a hash of its text from
    2 ** 62 on, after the usual ids; rows that share it by chance stay apart.
    """
    late = F.shiftrightunsigned(F.xxhash64(_text_key()), 2).bitwiseOR(F.lit(2**62))
    text = F.when(F.col("doc_id").isNull(), _text_key())
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), late)).withColumn("__text", text)
    kept = near_dup.drop_near_duplicates(keyed, id_col="__key", same=("__text",), width=5)
    return kept.select(*docs.columns)


@_apart
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    bench = _table(spark, sf_dir, "benchmark")
    return decontaminate.remove_contaminated(_keyed(docs), bench, id_col="__key").select(*docs.columns)


@_apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same weight, by repeating its documents."""
    return poisson_mix.mix(_keyed(docs), seed=SEED, id_col="__key").select(*docs.columns)


@_apart
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of near-equal bytes; adds ``size, virtual_slot, map_version, shard, slot``."""
    return slot_shards.assign(docs, SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
