"""Lines that recur over the corpus, found by range-partitioned hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.decontaminate import lower_ascii
from textloom.llm.frames import keep_runs, take_runs, without

BLANK = " \t\n\x0b\x0c\r"


def lines(text: str | Column) -> Column:
    """The lines of a text; null or empty is one empty line."""
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
) -> DataFrame:
    """``id, text_hash, keep``: for each text that loses lines, its run-length keep bitmap.

    ``keep`` lists the runs of lines that stay as ``from, len``, in order.

    A line's key is the line stripped of white space with A-Z lower-cased, as a
    128-bit hash; keys of fewer than ``min_chars`` characters never count. The
    hashes are partitioned by range of key and document and sorted by position
    inside, so a line that a third of all documents hold still spreads over
    many tasks. The first occurrences per document stream out of that order and
    are counted map-side; keys in ``min_docs`` documents or more lose all their
    lines. Only hashes and bitmaps are shuffled, no text.

    Rows with equal ids are one document when documents are counted; rows with
    equal ids and texts share one bitmap. Rows without an id are one document.
    """
    each = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.posexplode(F.transform(lines(text_col), line_key)).alias("pos", "key"),
    ).filter(F.char_length("key") >= min_chars)
    hashed = each.select(
        "id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )
    ranged = hashed.repartitionByRange("h1", "h2", "id")
    order = Window.partitionBy("h1", "h2", "id").orderBy("pos")
    first = ranged.withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    common = (
        first.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("held"))
        .filter(F.col("held") >= min_docs)
    )
    dropped = hashed.join(common.select("h1", "h2"), ["h1", "h2"], "left_semi")
    at = F.sort_array(F.collect_set("pos"))
    gaps = dropped.groupBy("id", "text_hash").agg(at.alias("gone"))
    return gaps.select(
        F.col("id").alias(id_col), "text_hash", keep_runs("gone").alias("keep"), F.size("gone").alias("n_dropped")
    )


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    Columns of these names are replaced; all others stay.
    """
    docs = without(docs, ("kept_text", "n_lines", "n_dropped"))
    marks = bitmaps.select(
        F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"),
        F.col("keep").alias("__keep"), F.col("n_dropped").alias("__dropped"),
    )
    mine = docs.withColumn("__own", F.xxhash64(F.col(text_col)))
    same = mine[id_col].eqNullSafe(marks["__id"]) & (mine["__own"] == marks["__hash"])
    found = mine.join(marks, same, "left").withColumn("__lines", lines(text_col))
    n = F.size("__lines")
    whole = F.array_join("__lines", "\n")
    kept = F.when(F.col("__keep").isNull(), whole).otherwise(F.array_join(take_runs("__lines", "__keep"), "\n"))
    return found.select(
        *[docs[c] for c in docs.columns],
        kept.alias("kept_text"),
        n.cast("long").alias("n_lines"),
        F.coalesce("__dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def drop_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits
) -> DataFrame:
    """``docs`` with the text that is left, see ``keep_bitmaps``."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, **limits), id_col, text_col)
