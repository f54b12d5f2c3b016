"""Pages by key range against a sort of all rows, with ranges of a few rows."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import kwic, paging, sampling
from textloom.operators.paging import SortKey
from textloom.sources import readers


@pytest.fixture(autouse=True)
def small_ranges(monkeypatch):
    monkeypatch.setattr(paging, "FEW_ROWS", 12)
    monkeypatch.setattr(paging, "SAMPLED", 20)
    monkeypatch.setattr(paging, "CUTS", 3)


def rank(row, keys):
    out = []
    for k in keys:
        value = row[k.name]
        null = (value is None) == k.nulls_last
        out.append((null, 0 if value is None else -value if k.descending else value))
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    rows = [
        (i, rng.choice([None, 1, 2, 2, 2, 2, 3, rng.randrange(100)]), rng.choice([None, 0.5, rng.random()]), f"text {i}")
        for i in range(300)
    ]
    return spark.createDataFrame(rows, "id long, a int, b double, text string").repartition(5).cache()


ORDERS = [
    [SortKey("id")],
    [SortKey("id", descending=True)],
    [SortKey("a", nulls_last=True), SortKey("id")],
    [SortKey("a", descending=True), SortKey("b", nulls_last=True), SortKey("id", descending=True)],
    [SortKey("b", descending=True, nulls_last=True), SortKey("id")],
]


@pytest.mark.parametrize("keys", ORDERS)
@pytest.mark.parametrize(("offset", "length"), [(0, 7), (140, 20), (290, 50), (300, 5), (37, None), (5, 0)])
def test_unique_keys(table, keys, offset, length):
    want = sorted(table.collect(), key=lambda r: rank(r, keys))
    want = want[offset:] if length is None else want[offset : offset + length]
    got = paging.rows_between(table, keys, offset, length)
    assert sorted(got.collect()) == sorted(want) and got.columns == table.columns


def test_ties_part_the_table(spark, table):
    """Pages by a key with ties hold every row once, each page its keys; equal rows count."""
    rows = table.drop("id", "text").unionByName(table.drop("id", "text").limit(40)).cache()
    keys = [SortKey("a", nulls_last=True)]
    want = sorted((rank(r, keys) for r in rows.collect()))
    seen = Counter()
    for offset in range(0, 340, 85):
        page = paging.rows_between(rows, keys, offset, 85).collect()
        assert sorted(rank(r, keys) for r in page) == want[offset : offset + 85]
        seen.update(map(tuple, page))
    assert seen == Counter(map(tuple, rows.collect()))


def test_one_hot_key(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), F.lit("x").alias("text"))
    want = sorted(r.k for r in rows.collect())
    for offset, length in ((0, 3), (1, 900), (700, 10), (1999, 1)):
        got = paging.rows_between(rows, ["k"], offset, length).collect()
        assert sorted(r.k for r in got) == want[offset : offset + length]


def test_types(spark):
    rows = [(dt.datetime(2024, 1, 1 + i % 9, i % 24), dt.date(2024, 1 + i % 12, 1), f"é{i % 7}'\\", i) for i in range(60)]
    df = spark.createDataFrame(rows, "t timestamp, d date, s string, i int")
    for order in (["t", "i"], ["d", "i"], ["s", "i"]):
        at = [df.columns.index(c) for c in order]
        want = sorted(rows, key=lambda r: [r[c].encode() if isinstance(r[c], str) else r[c] for c in at])
        assert sorted(map(tuple, paging.rows_between(df, order, 23, 11).collect())) == sorted(want[23:34])


def test_text_stays_where_it_is(spark, tmp_path):
    """A page's plan is a scan with a filter; no exchange, sort or written table."""
    path = str(tmp_path / "t")
    spark.range(500).select("id", F.concat(F.lit("some text "), "id").alias("text")).write.parquet(path)
    df = spark.read.parquet(path)
    for page in (
        kwic.document_page(df, ["id"], page=4, page_size=20), sampling.slice_rows(df, ["id"], 100, 50),
        sampling.table_page(df, "id", 3, 20), readers.preview(df, ["id"], 2, 20),
    ):
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan and "PushedFilters: [" in plan
        assert page.count() in (20, 50)
    assert "textloom-" not in "".join(kwic.document_page(df, ["id"]).inputFiles())


def test_empty_and_arguments(table):
    assert paging.rows_between(table.filter("false"), ["id"], 0, 5).collect() == []
    with pytest.raises(ValueError):
        paging.rows_between(table, ["id"], -1, 5)
