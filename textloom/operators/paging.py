"""Pages and slices by key range: the edges are found by counting, the page is a filtered scan."""

from __future__ import annotations

import operator
from bisect import bisect_left
from functools import reduce
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW_ROWS = 10_000  # keys of a range that are counted one by one
SAMPLED = 1_000  # keys drawn to cut a range
CUTS = 16


class SortKey(NamedTuple):
    """A column to sort by. Nulls come first unless ``nulls_last``, in both directions."""

    name: str
    descending: bool = False
    nulls_last: bool = False


class Edge(NamedTuple):
    """The key of a row of some rank, and the rows with smaller and with equal keys."""

    key: tuple
    before: int
    ties: int


def rows_between(
    df: DataFrame, order_by: list[str | SortKey], offset: int, length: int | None = None
) -> DataFrame:
    """``length`` rows after the first ``offset``, in the order of ``order_by``; not sorted.

    The keys of the first and the last row are found by counting rows between
    sampled keys, range by range: each round reads the key columns only and
    shuffles one count per range. The page is a scan with a filter on the keys,
    so no other column is sorted, shuffled or written, whatever the page's size.
    A key that many rows hold is a range of its own.

    Rows with equal keys that the page's edge parts are told apart by a hash of
    all their columns; rows equal in all columns are the same row. ``df`` must
    give the same rows each time it is read. The counting runs at once.
    """
    if offset < 0 or (length is not None and length < 0):
        raise ValueError("offset and length are not negative")
    keys = [k if isinstance(k, SortKey) else SortKey(k) for k in order_by]
    low, high = _edges(df, keys, offset + 1, None if length is None else offset + length)
    if low is None or length == 0:
        return df.limit(0)
    skip = offset - low.before
    last = high.ties if length is None or high.before + high.ties <= offset + length else offset + length - high.before
    parted = skip > 0 or last < high.ties
    if not parted:
        return df.filter(_from(keys, low.key, True) & _upto(keys, high.key, True))
    if low.key != high.key:
        between = df.filter(_from(keys, low.key, skip == 0) & _upto(keys, high.key, last == high.ties))
        first = _tied(df, keys, low.key, skip, None) if skip else None
        final = _tied(df, keys, high.key, 0, last) if last < high.ties else None
        return reduce(DataFrame.unionByName, [p for p in (first, between, final) if p is not None])
    return _tied(df, keys, low.key, skip, last - skip)


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def _tied(df: DataFrame, keys: list[SortKey], key: tuple, skip: int, length: int | None) -> DataFrame:
    """Some of the rows with one key, in the order of a hash of all columns."""
    name = "__row_hash"
    rows = df.filter(_equal(keys, key))
    if any(k.name == name for k in keys):  # equal in all columns: one row, as often as wanted
        total = count_rows(rows) if length is None else skip + length
        once = rows.limit(1)
        return once.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(total - skip)))).drop("__copy")
    if length == 0:
        return rows.limit(0)
    hashed = rows.withColumn(name, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return rows_between(hashed, [SortKey(name)], skip, length).drop(name)


def _edges(
    df: DataFrame, keys: list[SortKey], first: int, last: int | None
) -> tuple[Edge | None, Edge | None]:
    """The edges at the ranks ``first`` and ``last``, or the last row if there are fewer."""
    table = df.select([F.col(f"`{k.name}`").alias(f"k{i}") for i, k in enumerate(keys)])
    keys = [k._replace(name=f"k{i}") for i, k in enumerate(keys)]
    total = count_rows(table)
    if first > total:
        return None, None
    ranks = [first, total if last is None else max(first, min(last, total))]
    ranges = [(None, None, 0, total)]  # keys after the first and before the second, rows before and in it
    found: dict[int, Edge] = {}
    while len(found) < len(set(ranks)):
        rank = next(r for r in ranks if r not in found)
        low, high, before, held = min((x for x in ranges if x[2] < rank <= x[2] + x[3]), key=lambda x: x[3])
        inside = table.filter(_inside(keys, low, high))
        if held <= FEW_ROWS:
            each = inside.groupBy(*table.columns).agg(F.count(F.lit(1)).alias("n"))
            rows = [(tuple(r)[:-1], r["n"]) for r in each.orderBy(*_order(keys)).collect()]
            upto = [before, *accumulate((n for _, n in rows), initial=before)][1:]
            for r in ranks:
                if before < r <= before + held:
                    at = bisect_left(upto, r) - 1
                    found[r] = Edge(rows[at][0], upto[at], rows[at][1])
            continue
        drawn = inside.orderBy(F.rand(held)).limit(SAMPLED)  # any keys will do: they are read once
        drawn = [tuple(r) for r in drawn.distinct().orderBy(*_order(keys)).collect()]
        cuts = [drawn[i * len(drawn) // CUTS] for i in range(CUTS)] if len(drawn) > CUTS else drawn
        # Range 2 i lies before cut i, range 2 i + 1 is the cut itself.
        place = reduce(operator.add, [
            _from(keys, c, True).cast("int") + _from(keys, c, False).cast("int") for c in cuts
        ])
        counts = dict(map(tuple, inside.groupBy(place.alias("p")).count().collect()))
        for p in range(2 * len(cuts) + 1):
            n = counts.get(p, 0)
            if p % 2:
                found |= {r: Edge(cuts[p // 2], before, n) for r in ranks if before < r <= before + n}
            else:
                ranges.append((cuts[p // 2 - 1] if p else low, cuts[p // 2] if p < 2 * len(cuts) else high, before, n))
            before += n
    return found[ranks[0]], found[ranks[1]]


def _order(keys: list[SortKey]) -> list[Column]:
    out = []
    for k in keys:
        c = F.col(k.name)
        if k.descending:
            out.append(c.desc_nulls_last() if k.nulls_last else c.desc_nulls_first())
        else:
            out.append(c.asc_nulls_last() if k.nulls_last else c.asc_nulls_first())
    return out


def _after(key: SortKey, value) -> Column:
    """Whether a row's key comes after ``value``, null-safe."""
    column = F.col(f"`{key.name}`")
    if value is None:
        return F.lit(False) if key.nulls_last else column.isNotNull()
    beyond = column < F.lit(value) if key.descending else column > F.lit(value)
    return F.coalesce(beyond, F.lit(key.nulls_last))


def _same(key: SortKey, value) -> Column:
    return F.col(f"`{key.name}`").eqNullSafe(F.lit(value))


def _equal(keys: list[SortKey], key: tuple) -> Column:
    return reduce(operator.and_, [_same(k, v) for k, v in zip(keys, key, strict=True)])


def _from(keys: list[SortKey], key: tuple, itself: bool) -> Column:
    """Rows whose keys come after ``key``, or are it."""
    out = F.lit(itself)
    for k, v in reversed(list(zip(keys, key, strict=True))):
        out = _after(k, v) | (_same(k, v) & out)
    # The first key alone, which scans can use to skip files.
    return (_after(keys[0], key[0]) | _same(keys[0], key[0])) & out if len(keys) > 1 else out


def _upto(keys: list[SortKey], key: tuple, itself: bool) -> Column:
    return ~_from(keys, key, not itself)


def _inside(keys: list[SortKey], low: tuple | None, high: tuple | None) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & _from(keys, low, False)
    return out & _upto(keys, high, False) if high is not None else out
