"""Queries of tokens on tables of their own."""

from __future__ import annotations

import inspect

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.compare import compare
from textloom.functions import packed
from textloom.operators import ranks, tokens
from textloom.plans.catalog import QUERIES, SQL

TEXTS = ["Some words, some more.", None, "", " \n ", "?! ...", "É é 12", "one", "“”\tÀ"]


def written(folder, texts):
    """A folder with these documents, and DuckDB on them."""
    rows = [{"doc_id": i, "text": t, "lang": "de" if i % 2 else "en"} for i, t in enumerate(texts)]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())])
    pq.write_table(pa.Table.from_pylist(rows, schema), folder / "documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return str(folder), duck


def test_tokenise_texts_without_words(spark, tmp_path):
    """Null, empty and wordless texts have no token and no row, as in the SQL."""
    sf, duck = written(tmp_path, TEXTS)
    found = QUERIES["k1_tokenise"](spark, sf)
    assert compare(found, duck.sql(SQL["k1_tokenise"])) == []
    assert sorted(r["doc_id"] for r in found.collect()) == [0, 5, 6, 7]


@pytest.mark.parametrize("few", [1, 3, 1000])
def test_packed_tokens(monkeypatch, few):
    """Packing and unpacking gives the same lists: empty and missing ones, slices, far offsets, long texts."""
    monkeypatch.setattr(packed, "FRAME_TOKENS", few)
    monkeypatch.setattr(packed, "FRAME_BYTES", 100 * few)
    far = [{"token": "é", "start": 3, "end": 4}, {"token": "x" * 300, "start": 2**33, "end": 2**33 + 300}]
    lists = pa.array([far, None, [], [{"token": "", "start": 0, "end": 0}, {"token": "a b", "start": 9, "end": 12}], far[:1]], packed.ARROW_TYPE)
    pack, unpack = (inspect.unwrap(f.func) for f in (packed.pack_tokens, packed.unpack_tokens))
    for some in (lists, lists[1:], lists[2:3], lists[3:], lists[:0]):
        frames = list(unpack(iter(pack(iter([some])))))
        assert [r for f in frames for r in f.to_pylist()] == some.to_pylist()
    with pytest.raises(ValueError, match="offsets"):
        list(pack(iter([pa.array([[{"token": "a", "start": None, "end": 1}]], packed.ARROW_TYPE)])))


def test_copies_for_hot_keys(spark):
    """A right row is copied for the share of its key: not SPREAD times in a small table or for a small share."""
    left = spark.range(2000).select(F.when(F.col("id") < 20, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(2000).select(F.col("id").alias("k2"))
    joined = ranks.salted_join(left, right, "k", "k2", "left")
    assert joined.count() == 2000 and joined.filter("k2 is null").count() == 0
    n = left.groupBy("k").count()
    salts = [r[0] for r in n.select(ranks._salts(n, "count")).collect()]
    assert max(salts) == 10 and sum(salts) == 10 + 1980


def test_store_updates_leave_no_large_files(spark, tmp_path):
    """Text travels once, tokens packed, and starts and ends are stored as differences."""
    words = " ".join(f"{w} and" for w in range(3000))
    texts = [f"{i} {words}" for i in range(60)] + [None, "", "?!"] + [f"0 {words}"] * 10
    sf, duck = written(tmp_path, texts)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = str(tmp_path / "store")
    seen = []
    write = tokens._written
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokens, "_written", lambda rows, p: (seen.append(rows), write(rows, p)))
        tokens.update_token_store(docs, "text", path)
    store = tokens.read_store(spark, path, tokens.STORE_SCHEMA)
    assert store.count() == 62
    want = sorted((r["text"] or "") for r in docs.collect())
    got = docs.select(tokens.content_key(F.col("text")).alias("text_hash")).distinct()
    assert got.join(store, "text_hash", "left_anti").count() == 0 and len(set(want)) == 62
    plain = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plain.index("regexp_extract_all") < plain.index("Sort [") < plain.index("Exchange hashpartitioning(bucket")
    columns = pq.ParquetFile(store.inputFiles()[0].removeprefix("file://")).metadata.row_group(0)
    kinds = {c.path_in_schema: (c.compression, c.encodings) for c in map(columns.column, range(columns.num_columns))}
    packing, ways = kinds["tokens.list.element.start"]
    assert packing == "ZSTD" and "DELTA_BINARY_PACKED" in ways
    assert compare(QUERIES["k5_two_models"](spark, sf), duck.sql(SQL["k5_two_models"].replace("documents", "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"))) == []
    joined = tokens.tokenise_from_store(docs, "text", path, "whitespace")
    name = tokens.find_derived(joined, "text", model="whitespace")
    fresh = tokens.tokenise(docs, "text", "whitespace")
    same = joined.select("doc_id", F.to_json(name)).exceptAll(fresh.select("doc_id", F.to_json(name)))
    assert same.count() == 0 and joined.count() == len(texts)
