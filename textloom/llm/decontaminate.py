"""Benchmark decontamination: a broadcast hash set of n-grams, scanned by a join."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.frames import keep_runs, take_runs

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS = 200_000  # of about 150 bytes each; more are joined by a shuffle


def lower_ascii(text: str | Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: str | Column) -> Column:
    """Lower-cased words; none for null."""
    found = F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _starts(count: Column, length: int) -> Column:
    """Offsets at which a window of ``length`` words fits."""
    none = F.array().cast("array<int>")
    return F.when(count >= length, F.sequence(F.lit(0), count - length)).otherwise(none)


def _windows(items: Column, count: Column, length: int) -> Column:
    """All windows of ``length`` words, as ``pos, len, h``."""
    return F.transform(
        _starts(count, length),
        lambda i: F.struct(
            i.alias("pos"),
            F.lit(length).alias("len"),
            F.xxhash64(F.slice(items, i + 1, length)).alias("h"),
        ),
    )


def benchmark_windows(
    benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10
) -> DataFrame:
    """Distinct windows ``h, len, gram`` with the items that hold them.

    An item of fewer words than ``size``, but not none, is one window.
    """
    read = benchmark.select(F.col(id_col).alias("item"), words(text_col).alias("w"))
    n = F.size("w")
    length = F.least(n, F.lit(size))
    grams = read.filter(n > 0).select(
        "item",
        F.explode(
            F.transform(F.sequence(F.lit(0), n - length), lambda i: F.slice("w", i + 1, length))
        ).alias("gram"),
    )
    return grams.groupBy(
        F.xxhash64("gram").alias("h"), F.size("gram").alias("len"), "gram"
    ).agg(F.collect_set("item").alias("items"))


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 10,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """``id, n_words, n_hit, spans, items`` for every row of ``docs``.

    Words are runs of letters, digits and non-ASCII characters, A-Z
    lower-cased. The windows of the benchmark are counted first and broadcast
    as a hash set if there are at most ``broadcast_windows``; otherwise the same
    join shuffles. Every window of a document probes the set; a hash that hits
    is verified on the words. ``spans`` are the hits as ``pos, len`` in words,
    ``n_hit`` the words inside any of them, ``items`` the ids of the items hit.

    Documents are not joined back: each sends one marker through the same join,
    so a text is read once and never shuffled. Null or empty texts have no
    words. Rows with equal ids stay apart. Items that repeat are listed once per
    id; items without an id count as hits but are not listed. An empty benchmark
    hits nothing. Other columns are ignored.
    """
    grams = benchmark_windows(benchmark, text_col=text_col, size=size)
    sizes = grams.groupBy("len").count().collect()  # one row per length, ``size`` at most
    lengths = sorted(r["len"] for r in sizes)
    marker = grams.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("h"), F.lit(0).alias("len"),
        F.array().cast("array<string>").alias("gram"),
        F.array().cast(grams.schema["items"].dataType).alias("items"),
    )
    known = grams.unionByName(marker)
    read = docs.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        words(text_col).alias("w"),
    )
    n = F.size("w")
    own = F.array(F.struct(n.alias("pos"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("h")))
    probes = F.concat(own, *[_windows(F.col("w"), n, length) for length in lengths])
    rows = read.select("id", "row", "w", F.explode(probes).alias("p"))
    here = F.slice("w", F.col("p.pos") + 1, F.col("p.len"))
    if sum(r["count"] for r in sizes) <= broadcast_windows:
        on = (F.col("p.h") == F.col("h")) & (F.col("p.len") == F.col("len"))
        hits = rows.join(F.broadcast(known), on)
    else:
        rows = rows.select("id", "row", "p", here.alias("here"))
        here = F.col("here")
        on = (F.col("p.h") == F.col("h")) & (F.col("p.len") == F.col("len"))
        hits = rows.join(known.hint("merge"), on)
    hits = hits.filter((F.col("p.len") == 0) | (here == F.col("gram")))
    span = F.struct(F.col("p.pos").alias("pos"), F.col("p.len").alias("len"))
    grouped = hits.groupBy("row", "id").agg(
        F.max(F.when(F.col("p.len") == 0, F.col("p.pos"))).alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("p.len") > 0, span))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    return grouped.select(
        F.col("id").alias(id_col), "row",
        F.col("n_words").cast("long").alias("n_words"),
        covered("spans").alias("n_hit"), "spans", "items",
    )


def covered(spans: str) -> Column:
    """Words inside any of the sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, s: Column) -> Column:
        end = s["pos"] + s["len"]
        new = F.greatest(F.lit(0), end - F.greatest(s["pos"], state["end"]))
        return F.struct(F.greatest(end, state["end"]).alias("end"), (state["n"] + new).alias("n"))

    return F.aggregate(spans, start, step, lambda state: state["n"])


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options
) -> DataFrame:
    """The rows of ``docs`` without the documents that hold a window of the benchmark.

    A row without an id is judged by its text alone: such rows are scanned but
    stay, as no decision can be joined to them.
    """
    bad = scan(docs, benchmark, id_col=id_col, **options).filter("n_hit > 0")
    return docs.join(bad.select(id_col).distinct(), id_col, "left_anti").select(*docs.columns)


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` with the words of all hits, and what follows each up to the next word, cut out."""
    hits = scan(docs, benchmark, id_col=id_col, text_col=text_col, **options).filter("n_hit > 0")
    inside = F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))
    gone = hits.groupBy(id_col).agg(F.first(F.array_sort(F.array_distinct(F.flatten(inside)))).alias("__gone"))
    gone = gone.withColumnRenamed(id_col, "__id")
    letter = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    # A piece is a word with what follows it; piece 0 is what stands before the first word.
    pieces = F.split(F.col(text_col), rf"(?<!{letter})(?={letter})")
    lead = F.when(F.col(text_col).rlike(rf"^{letter}"), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    cut = docs.join(gone, F.col(id_col) == F.col("__id"), "left").withColumns(
        {"__pieces": F.concat(lead, pieces), "__gone": F.transform("__gone", lambda p: p + 1)}
    )
    cut = cut.withColumn("__runs", keep_runs("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(
        F.array_join(take_runs("__pieces", "__runs"), "")
    )
    return cut.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
