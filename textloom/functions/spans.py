"""Regex matches with character offsets, and cheap slices of long texts.

Everything here is a Column expression evaluated inside one row, so nothing is
shuffled. Work per document stays linear in its length: offsets are summed in
blocks, and slices are cut from fixed-size chunks instead of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_BITS = 4
BLOCK = 1 << BLOCK_BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    A plain column alias would be inlined again by the optimizer, and inside a
    lambda that means one evaluation per array element. A fold over no elements
    binds its start value and hands on the result as it is; a transform of one
    element would copy all arrays and texts in it.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def choose(test: Column, then: Column, other: Column) -> Column:
    """SQL's ``if``, which costs less per array element than a case expression."""
    return F.call_function("if", test, then, other)


def quote_literal(text: str) -> str:
    """Escape ``text`` so that a regex matches it literally."""
    return re.sub(r"([\\.+*?()|\[\]{}^$#&~\-/])", r"\\\1", text)


def check_pattern(pattern: str) -> str:
    """Reject patterns that match the empty string: they have no span."""
    if not pattern:
        raise ValueError("the search pattern is empty")
    try:
        empty_match = re.match(pattern, "") is not None
    except re.error:
        empty_match = False  # Java-only syntax; Spark reports real errors
    if empty_match:
        raise ValueError(f"pattern {pattern!r} matches the empty string")
    return pattern


def span_type(name: str) -> str:
    return f"array<struct<{name}:string,start:bigint,end:bigint>>"


def _running(steps: Column) -> Column:
    """Running sums of ``steps`` inside every block of ``BLOCK`` elements.

    Each pass joins pairs of finished runs into runs of twice the length: the
    second run of a pair adds the last sum of the first one.
    """

    def joined(bit: int) -> Callable[[Column], Column]:
        def add(bound: Column, x: Column, i: Column) -> Column:
            before = F.get(bound, i.bitwiseAND(F.lit(-bit)) - F.lit(1))
            return choose(i.bitwiseAND(F.lit(bit)) == 0, x, x + before)

        return lambda bound: F.transform(bound, lambda x, i: add(bound, x, i))

    for k in range(BLOCK_BITS):
        steps = let(steps, joined(1 << k))
    return steps


def _bases(sums: Column) -> Column:
    """Where every block begins: the running sums of the blocks before it, in doubling steps."""
    totals = F.transform(
        F.sequence(F.lit(0), F.shiftright(F.size(sums) - 1, BLOCK_BITS)),
        lambda k: F.coalesce(F.get(sums, k * BLOCK - 1), F.lit(0).cast("bigint")),
    )

    def doubled(bound: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(
            bound, lambda x, i: choose(i >= step, x + F.get(bound, i - step), x)
        )

    def total(bound: Column) -> Column:
        passes = F.ceil(F.log2(F.size(bound))).cast("int")
        return F.aggregate(F.sequence(F.lit(0), passes), bound, doubled)

    return let(totals, total)


def regex_pieces(text: Column, pattern: str, name: str = "text", fold: bool = False) -> Column:
    """``spans`` as ``regex_spans`` and ``gaps``, the texts before, between and behind them."""
    check_pattern(pattern)
    body = F.coalesce(text, F.lit(""))
    both = F.struct(
        F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("found"),
        F.split(body, pattern, -1).alias("gaps"),
    )

    def zipped(found: Column, ends: Column) -> Column:
        texts = F.transform(found, F.lower) if fold else found
        starts = F.transform(ends, lambda end, i: end - F.length(F.get(found, i)))
        return F.arrays_zip(texts, starts, ends).cast(span_type(name))

    def spans(found: Column, sums: Column) -> Column:
        def shifted(bases: Column) -> Column:
            return F.transform(
                sums, lambda end, i: end + F.get(bases, F.shiftright(i, BLOCK_BITS))
            )

        ends = choose(F.size(sums) <= BLOCK, sums, let(_bases(sums), shifted))
        return let(ends, lambda bound: zipped(found, bound))

    def pieces(b: Column) -> Column:
        found, gaps = b["found"], b["gaps"]
        steps = F.transform(
            found, lambda x, i: (F.length(x) + F.length(F.get(gaps, i))).cast("bigint")
        )
        none = F.array().cast(span_type(name))
        located = choose(
            F.size(found) == 0, none, let(_running(steps), lambda sums: spans(found, sums))
        )
        return F.when(
            F.size(gaps) == F.size(found) + 1,
            F.struct(located.alias("spans"), gaps.alias("gaps")),
        ).otherwise(F.raise_error(F.lit(f"pattern {pattern} has matches without a span")))

    return let(both, pieces)


def regex_spans(text: Column, pattern: str, name: str = "text", fold: bool = False) -> Column:
    """All matches of ``pattern`` as ``array<struct<text, start, end>>``.

    Offsets are zero-based characters, ``end`` exclusive. Null gives an empty
    array. ``name`` is the field of the matched text, lower-cased with ``fold``.
    """
    return regex_pieces(text, pattern, name, fold)["spans"]


def chunk_bits(width: int, least: int = 7) -> int:
    """Bits of the smallest power of two that is at least ``width``."""
    return max(least, (width - 1).bit_length())


def chunked(text: Column, bits: int) -> Column:
    """``text`` cut into pieces of ``2**bits`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << bits}}}"), F.lit(0))


def chunk_at(position: Column, bits: int) -> tuple[Column, Column]:
    """Number of the chunk that holds a character, and the place inside it."""
    return (
        F.shiftright(position, bits).cast("int"),
        position.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"),
    )


def piece(chunks: Column, number: Column) -> Column:
    return F.coalesce(F.get(chunks, number), F.lit(""))


def cut(text: Column, chunks: Column, bits: int, start: Column, end: Column) -> Column:
    """Characters ``[start, end)`` of ``text``, read from at most two chunks.

    ``substring`` walks a text from its beginning, so many slices of one long
    text would cost its length each. Slices longer than a chunk fall back to
    the whole text.
    """
    number, inside = chunk_at(start, bits)
    width = (end - start).cast("int")
    return (
        F.when(width <= 0, F.lit(""))
        .when(
            inside + width <= (1 << bits), F.substring(piece(chunks, number), inside + 1, width)
        )
        .when(
            width <= (1 << bits),
            F.substring(
                F.concat(piece(chunks, number), piece(chunks, number + 1)), inside + 1, width
            ),
        )
        .otherwise(F.substring(text, (start + 1).cast("int"), width))
    )
