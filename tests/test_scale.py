"""Bounds of what a task holds, reads or writes, and offsets of many matches."""

from __future__ import annotations

import inspect
import io
import re
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import spans
from textloom.operators import quotes, tokens
from textloom.plans import tables
from textloom.sources import readers


def test_spans_of_many_matches(spark):
    """Offsets over block borders, up to more blocks than one holds elements."""
    texts = ["é a" * n for n in (0, 1, 15, 16, 17, 33, 300, 1000)] + [None, "   ", "xyz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", spans.regex_spans(F.col("t"), "[a-y]", "m").alias("s")).collect():
        want = [(m.group(), m.start(), m.end()) for m in re.finditer("[a-y]", row["t"] or "")]
        assert [tuple(x) for x in row["s"]] == want


def test_binding_copies_nothing(spark):
    """A bound value is a fold over nothing, not the one element of an array."""
    df = spark.range(1).select(spans.let(F.array(F.lit(1), F.lit(2)), lambda a: F.size(a)).alias("n"))
    assert df.first()["n"] == 2 and "transform" not in df._jdf.queryExecution().analyzed().toString()


def test_preprocessing_in_small_frames(monkeypatch):
    """Offsets of a few texts at a time, not of a whole batch."""
    monkeypatch.setattr(quotes, "FRAME_CHARS", 50)
    texts = ["one\ntwo  three", "", None, "é" * 60, '“a”..\n "b"', "x" * 30] * 5
    got = list(quotes.preprocessed.func(iter([pa.array(texts[:20]), pa.array(texts[20:]), pa.array([], pa.string())])))
    assert len(got) > 8 and max(len(g) for g in got) <= 6
    rows = [(r["text"], r["offsets"]) for g in got for r in g.to_pylist()]
    assert rows == [quotes.preprocess(t or "") for t in texts]
    assert isinstance(quotes._preprocess("a\nb")[1], np.ndarray)


def test_quotation_windows_end_at_marks(spark):
    """A long line of quotations is looked at piece by piece."""
    line = ' "a" '.join(f"word{i}" for i in range(300)) + ' he said: "last," replied Ann Lee'
    df = spark.createDataFrame([(line,)], "t string")
    found = df.select(quotes.quotations(F.col("t")).alias("q")).first()["q"]
    assert len(found) == 300 and [q["speaker"] for q in found if q["speaker"]] == ["Ann Lee"]
    plan = df.select(quotes.quotations(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "substring_index" in plan


def test_archives_in_small_frames(monkeypatch):
    monkeypatch.setattr(tables, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(readers, "FRAME_BYTES", 2000)
    columns = [list(range(40)), ["s"] * 40, ["text " * 100] * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "source", "text"])
    archives = list(tables.zipped(iter([batch])))
    assert len(archives) == 20 and all(a.num_rows == 1 for a in archives)
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as archive:
        for i in range(40):
            archive.writestr(f"{i}.txt", b"x" * 500)
    frames = list(readers._members(iter([pa.RecordBatch.from_arrays([pa.array([whole.getvalue()])], ["content"])])))
    assert [f.num_rows for f in frames] == [4] * 10
    decode = inspect.unwrap(readers._decoder("utf-8", "strict").func)
    raw = [b"a" * 1500, b"\xff", b"b" * 1500, b"c"]
    got = list(decode(iter([pa.array(raw), pa.array([], pa.binary())])))
    assert [g.to_pylist() for g in got] == [["a" * 1500, None, "b" * 1500], ["c"], []]


def docs(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("some text of number "), "id").alias("text"))


def test_store_folders_are_split_by_size(spark, tmp_path, monkeypatch):
    """A folder too large for one task is written by several; a small store keeps few files."""
    small, large, target = (str(tmp_path / name) for name in ("small", "large", "target"))
    tokens.update_token_store(docs(spark, 3000), "text", small)
    monkeypatch.setattr(tokens, "PART_BYTES", 1000)
    tokens.update_token_store(docs(spark, 3000), "text", large)
    a, b = (tokens.read_store(spark, p, tokens.STORE_SCHEMA) for p in (small, large))
    assert len(a.inputFiles()) <= 64 < len(b.inputFiles())
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 3000
    # Every file has a Bloom filter of about 1 MB.
    monkeypatch.setattr(tokens, "PART_BYTES", 512 << 10)
    tokens.compact_store(spark, small, target, tokens.STORE_SCHEMA, 4)
    compact = tokens.read_store(spark, target, tokens.STORE_SCHEMA)
    assert len(compact.inputFiles()) > 16 and sorted(compact.collect()) == sorted(a.collect())


def test_vectors_are_split_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "PART_BYTES", 1000)
    path = str(tmp_path / "vectors")
    rows = spark.range(2000).select(
        tokens.vector_key(F.col("id").cast("string"), "m", "p").alias("content_hash"),
        F.array_repeat(F.col("id").cast("float"), 8).alias("embedding"),
    )
    tokens.store_vectors(rows, path, "m", "2024-01-01 00:00:00")
    store = tokens.read_store(spark, path, tokens.VECTOR_SCHEMA)
    assert store.count() == 2000 and len(store.inputFiles()) > 32
