"""Global row numbers and lookups that hold up under size and skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import staged

HOT_SHARE = 1000  # a key is hot if it holds at least 1/HOT_SHARE of the rows
SPREAD = 64
ROW_BITS = 33  # of monotonically_increasing_id: the lower bits count rows


def with_row_index(
    df: DataFrame, order_by: list[str | Column], name: str = "row_index"
) -> DataFrame:
    """Number all rows from 1 in the order of ``order_by``, without one big window.

    The rows are range-sorted and written once, numbered inside their
    partition; each partition then needs only the size of those before it. The
    keys should be unique: ties get any order, and equal keys share a task.
    """
    at = "__at"
    placed = staged(
        df.orderBy(*order_by).withColumn(at, F.monotonically_increasing_id()), "row-index"
    )
    part = F.shiftright(at, ROW_BITS)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition of the sort.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base")
    )
    inside = F.col(at) - F.shiftleft(F.shiftright(at, ROW_BITS), ROW_BITS)
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(bases), "__part")
        .withColumn(name, (F.col("__base") + inside + 1).cast("bigint"))
        .drop("__part", "__base", at)
    )


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Keys with a large share of all rows: at most HOT_SHARE of them."""
    total = counts.agg(F.sum(n).alias("t")).scalar()
    return counts.filter(F.col(key).isNotNull() & (F.col(n) * HOT_SHARE >= total))


def spread_lookup(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Left join with a table of unique keys whose ``value`` is their row count.

    Hot keys are few, so their values are broadcast. Their rows, and rows
    without a key, get a salt that nothing matches and spread evenly over the
    shuffle.
    """
    hot = hot_keys(table, key, value).withColumnRenamed(value, "__hot")
    tagged = df.join(F.broadcast(hot), key, "left")
    rare = F.col("__hot").isNull() & F.col(key).isNotNull()
    # Copies of a row differ in where they stand, so they spread too.
    spread = F.lit(1) + F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    salt = F.when(rare, F.lit(0)).otherwise(spread)
    salted = tagged.withColumn("__salt", salt.cast("int"))
    cold = table.withColumns({"__cold": F.col(value), "__salt": F.lit(0)}).drop(value)
    joined = salted.join(cold, [key, "__salt"], "left")
    return joined.withColumn(value, F.coalesce("__hot", "__cold")).select(*df.columns, value)


def _salts(counts: DataFrame, n: str) -> Column:
    """Over how many tasks the ``n`` rows of a key are spread, each to get its HOT_SHARE of all rows."""
    total = counts.agg(F.sum(n).alias("t")).scalar()
    return F.least(F.lit(SPREAD), n, F.ceil(F.col(n) * HOT_SHARE / total)).cast("int")


def salted_join(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str
) -> DataFrame:
    """Equi-join whose hot keys are spread over many tasks.

    Rows of a hot left key get one of SPREAD salts at most, fewer if that leaves
    less than 1/HOT_SHARE of all rows to a salt, and the matching right rows one
    copy per salt: a key for each right row has one or two on average. A right join spreads the hot keys of the right side; a
    full join is the left join and the right rows that match nothing. The result
    keeps all columns of both sides.
    """
    if how == "right":
        swapped = salted_join(right, left, right_on, left_on, "left")
        return swapped.select(*left.columns, *right.columns)
    if how == "full":
        matched = salted_join(left, right, left_on, right_on, "left")
        keys = left.select(F.col(left_on).alias("__key")).distinct()
        lone = right.join(keys, F.col(right_on) == F.col("__key"), "left_anti")
        return matched.unionByName(lone, allowMissingColumns=True)
    if how not in ("inner", "left"):
        raise ValueError("salting works for inner, left, right and full joins")
    counts = left.groupBy(F.col(left_on).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    # HOT_SHARE keys at most.
    hot = hot_keys(counts, "__key", "__n").select("__key", _salts(counts, "__n").alias("__hot"))
    hot = F.broadcast(hot.filter("__hot > 1"))
    # Copies of a row differ in where they stand.
    pick = F.pmod(
        F.monotonically_increasing_id(), F.when(F.col(left_on).isNull(), SPREAD).otherwise(F.coalesce("__hot", F.lit(1)))
    ).cast("int")
    l_side = (
        left.join(hot, left[left_on] == hot["__key"], "left")
        .withColumn("__ls", pick)
        .drop("__hot", "__key")
    )
    copies = F.sequence(F.lit(0), F.coalesce("__hot", F.lit(1)) - 1)
    r_side = (
        right.join(hot, right[right_on] == hot["__key"], "left")
        .withColumn("__rs", F.explode(copies))
        .drop("__hot", "__key")
    )
    match = (l_side[left_on] == r_side[right_on]) & (l_side["__ls"] == r_side["__rs"])
    return l_side.join(r_side, match, how).drop("__ls", "__rs")
