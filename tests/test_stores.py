"""The layout of the token and vector stores: what updates and lookups open."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from textloom.operators import tokens


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark, ids):
    return spark.createDataFrame([(i, f"text number {i}") for i in ids], "id long, text string")


def test_update_reads_keys_of_some_folders(spark, tmp_path, monkeypatch):
    """Known texts open no token column, and a few texts only their folders."""
    path = str(tmp_path / "store")
    tokens.update_token_store(docs(spark, range(200)), "text", path)
    assert {d[:7] for d in os.listdir(path) if d[0] == "b"} == {"bucket="}
    store = tokens.read_store(spark, path, tokens.STORE_SCHEMA)
    wanted = docs(spark, [3, 5]).select(tokens.content_key(F.col("text")).alias("text_hash"))
    near = tokens.near_keys(store, wanted)
    assert near.select(F.input_file_name()).distinct().count() <= 2 < len(store.inputFiles())
    opened = []
    original = tokens.staged
    monkeypatch.setattr(tokens, "staged", lambda df, label: (opened.append((label, plan(df))), original(df, label))[1])
    tokens.update_token_store(docs(spark, range(150, 200)), "text", path)
    unseen = dict(opened)["unseen"]
    assert "text_hash:string" in unseen and "tokens:array" not in unseen
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", unseen)
    monkeypatch.undo()
    read = tokens.read_token_store(spark, path)
    assert read.count() == 200 and "Exchange" not in plan(read)


def test_double_keys(spark, tmp_path):
    """Two updates at one time leave keys twice: reads and compaction give each once."""
    path, target = str(tmp_path / "store"), str(tmp_path / "compact")
    both = docs(spark, range(40))
    fresh = both.select(
        tokens.content_key(F.col("text")).alias("text_hash"), tokens.token_spans(F.col("text"), "word").alias("tokens")
    )
    tokens.append_store(fresh, path)
    tokens.append_store(fresh.limit(15), path)
    store = tokens.read_store(spark, path, tokens.STORE_SCHEMA)
    assert store.count() == 55
    for limit in (0, 100):
        one = tokens.distinct_keys(store, limit)
        assert one.count() == 40 and one.select("text_hash").distinct().count() == 40
    assert tokens.read_token_store(spark, path).count() == 40
    assert tokens.compact_store(spark, path, target, tokens.STORE_SCHEMA, 4) == len(store.inputFiles())
    compact = tokens.read_store(spark, target, tokens.STORE_SCHEMA)
    assert compact.count() == 40 and len(compact.inputFiles()) <= 16


def test_vectors(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = spark.range(300).select(
        tokens.vector_key(F.col("id").cast("string"), "m", "p").alias("content_hash"), F.array(F.col("id").cast("float")).alias("embedding")
    )
    tokens.store_vectors(rows, path, "m", "2024-01-01 00:00:00")
    tokens.store_vectors(rows.limit(100).withColumn("embedding", F.array(F.lit(-1.0))), path, "m", "2024-02-01 00:00:00")
    store = tokens.read_store(spark, path, tokens.VECTOR_SCHEMA)
    hits, missing = tokens.lookup_vectors(rows.select("content_hash"), store)
    assert hits.count() == 300 and hits.filter("embedding[0] = -1").count() == 100 and missing.count() == 0
    other = spark.range(1).select(tokens.vector_key(F.lit("none"), "m", "p").alias("content_hash"))
    hits, missing = tokens.lookup_vectors(other, store)
    assert hits.count() == 0 and missing.count() == 1
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan(hits))
    hits, missing = tokens.lookup_vectors(other, tokens.read_store(spark, path + "-none", tokens.VECTOR_SCHEMA))
    assert hits.count() == 0 and missing.count() == 1
