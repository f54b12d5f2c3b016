"""Pages, slices, exact-size seeded samples and shuffles.

Samples order rows by a hash of seed and id. The hash of the last wanted row
is found by counting hash prefixes, so a sample is a plain filter of the scan:
no row is sorted or shuffled, whatever the sample's size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.paging import SortKey, count_rows, rows_between

HASH_DIGITS = 4  # 16**4 prefixes


def hash_order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def _cutoff(df: DataFrame, id_col: str, seed: int, wanted: Callable[[Column], Column]) -> Column:
    """Hash of the last row of a sample of ``wanted(total)`` rows, as a scalar."""
    hashed = df.select(hash_order(id_col, seed).alias("h"))
    prefix = F.substring("h", 1, HASH_DIGITS)
    counts = hashed.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    total = hashed.agg(F.count(F.lit(1)).alias("n")).scalar()
    # At most 16**HASH_DIGITS rows.
    running = counts.withColumn("upto", F.sum("n").over(Window.orderBy("p")))
    rank = wanted(total)
    edge = running.filter((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).select(
        "p", (rank - (F.col("upto") - F.col("n"))).alias("inside")
    )
    # Only the rows of one prefix are ordered.
    near = hashed.join(F.broadcast(edge), prefix == F.col("p"))
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("h")))
    return ranked.filter(F.col("r") == F.col("inside")).select("h").scalar()


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows, or all if there are fewer. ``id_col`` must be unique."""
    if n < 1:
        raise ValueError("the sample size is positive")
    cutoff = _cutoff(df, id_col, seed, lambda total: F.least(F.lit(n), total))
    return df.filter(hash_order(id_col, seed) <= cutoff)


def sample_fraction(
    df: DataFrame, id_col: str, fraction: float, seed: int = 0, at_least: int = 0
) -> DataFrame:
    """Exactly floor(fraction * rows) rows, but no fewer than ``at_least``."""
    if fraction <= 0:
        raise ValueError("the fraction is positive")
    if fraction >= 1:
        return df
    cutoff = _cutoff(
        df,
        id_col,
        seed,
        lambda total: F.greatest(
            F.lit(at_least).cast("bigint"), F.floor(total * F.lit(fraction)).cast("bigint")
        ),
    )
    return df.filter(hash_order(id_col, seed) <= cutoff)


def corpus_sample(df: DataFrame, id_col: str, fraction: float, seed: int) -> DataFrame:
    """A corpus sample: never empty, and the whole corpus from 1 on."""
    return sample_fraction(df, id_col, fraction, seed, at_least=1)


def sample_corpora(
    corpora: list[tuple[str, DataFrame]], id_col: str, fraction: float, seed: int
) -> DataFrame:
    """One sample per corpus, each with its own seed, tagged by corpus."""
    out = None
    for i, (name, df) in enumerate(corpora):
        part = corpus_sample(df, id_col, fraction, seed + i).withColumn("corpus", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def shuffled(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """All rows with their ``position`` (from 1) in a seeded random order.

    Rows are ranked inside their hash prefix; the prefixes before it are added.
    """
    hashed = df.withColumn("__h", hash_order(id_col, seed)).withColumn(
        "__p", F.substring("__h", 1, HASH_DIGITS)
    )
    keys = df.select(F.substring(hash_order(id_col, seed), 1, HASH_DIGITS).alias("__p"))
    counts = keys.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy("__h"))
    return (
        hashed.withColumn("__r", rank)
        .join(F.broadcast(bases), "__p")
        .select(*df.columns, (F.col("__base") + F.col("__r")).cast("bigint").alias("position"))
    )


def slice_rows(
    df: DataFrame, order_by: list[str], offset: int = 0, length: int | None = None
) -> DataFrame:
    """Rows ``offset`` .. ``offset + length``, or all after ``offset``."""
    return rows_between(df, order_by, offset, length)


def table_page(
    df: DataFrame,
    id_col: str,
    page: int = 1,
    page_size: int = 20,
    sort_by: str | None = None,
    descending: bool = False,
) -> DataFrame:
    """One page of a table, nulls last in both directions, ties by id.

    ``total_rows`` repeats the number of rows of the whole table.
    """
    order = [SortKey(id_col)]
    if sort_by and sort_by in df.columns and sort_by != id_col:
        order.insert(0, SortKey(sort_by, descending, nulls_last=True))
    elif sort_by == id_col and descending:
        order = [SortKey(id_col, descending=True, nulls_last=True)]
    rows = rows_between(df, order, (page - 1) * page_size, page_size)
    return rows.withColumn("total_rows", F.lit(count_rows(df)).cast("bigint"))


def head_and_tail(df: DataFrame, order: list[Column], reverse: list[Column], n: int) -> DataFrame:
    """The first and the last ``n`` rows, each a top-k; overlap counts once."""
    return df.orderBy(*order).limit(n).union(df.orderBy(*reverse).limit(n)).distinct()
