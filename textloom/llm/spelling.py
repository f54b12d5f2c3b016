"""Spelling variants: a trie over letter-group counts, searched with a budget of one each way."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import Scratch

GROUPS = 16  # of letters, and levels of the trie
SUBTRIE = 65_536  # words of a subtrie, and of a block of one leaf
QUERIES = 131_072  # words that search one copy of a subtrie
LEAF = 32  # words at a node below which the counts left are compared at once
MUTATE = 31  # one run in so many loses a letter

_BLOCK = 2048  # searches compared at once at a leaf
_RUN = re.compile("[a-zÀ-ÿ]+")  # after lower-casing A-Z

# What is spent: nothing, a surplus, a deficit, both. A surplus comes before the deficit of a pair,
# so that two words of equal length meet once; a word meets those a letter shorter by a deficit.
_NONE, _SURPLUS, _DEFICIT, _BOTH = range(4)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mutate: int = MUTATE) -> DataFrame:
    """``word, n``: the runs of Latin letters in all texts, A-Z lower-cased.

    With h the crc32 of ``<id>:<run>``, a run loses the letter ``h % length`` if
    ``mutate`` divides h; 0 leaves all runs as they are. A null id counts as ''.
    Null and empty texts have no runs. Runs are counted per batch, then summed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter[str] = Counter()
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                runs = Counter(_RUN.findall((text.as_py() or b"").lower().decode("utf-8", "replace")))
                begin = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in runs.items():
                    if mutate:
                        h = zlib.crc32(run.encode(), begin)
                        if h % mutate == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                    held[run] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
            )

    source = docs.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text")
    )
    counted = source.mapInArrow(count, "word string, n long")
    return counted.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def variants(words: DataFrame, ratio: int = 10, subtrie: int = SUBTRIE, queries: int = QUERIES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words``, distinct ``word, n``.

    Two words are near if they differ by one inserted, deleted or replaced code
    point. ``form`` is the near word of the largest n, ties to the smallest in
    code-point order, if that is at least ``ratio`` times the word's n; ``root``
    follows forms to the last. Null and empty words have no near words.

    The alphabet is dealt to GROUPS groups of about equal use. Words are
    arranged in a trie by how many of their letters fall in the first group, the
    second and so on. A search goes down the trie; on its way the counts may be
    higher by one once and lower by one once, as one edit moves them by no more.
    The words of the leaves are verified. Nodes with more than ``subtrie`` words
    are passed by joins on their paths, one level at a time; below them, a task
    searches depth first in a subtrie that fits, for at most ``queries`` words.
    A leaf with more words, all of equal counts, is cut into blocks, which every
    search of the leaf visits.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.table(words.select("word", F.col("n").cast("long").alias("n")), "words")
    vectors = _vectors(words.filter("word <> ''"), _letter_groups(words))
    vectors = scratch.table(vectors, "vectors")
    roots, inner, depth = _nodes(scratch, vectors, subtrie)
    pairs = scratch.table(_search(scratch, vectors, roots, inner, depth, queries), "near")
    both = pairs.unionByName(pairs.toDF("near", "near_n", "word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    found = words.join(near, "word", "left").withColumn("form_n", -F.col("best.minus"))
    is_form = F.col("form_n") >= ratio * F.col("n")
    found = found.select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("form_n")).alias("form_n"),
    )
    found = scratch.table(found, "forms")
    roots = found.filter("form is not null").select("word", F.col("form").alias("root"))
    roots = _last(scratch, scratch.table(roots, "first-forms"))
    out = found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
    return scratch.finish(out)


def _last(scratch: Scratch, links: DataFrame) -> DataFrame:
    """``word, root`` with every root followed to its own; n grows along a chain, so it is short."""
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(onward, "root", "left")
        moved = scratch.table(
            moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")),
            "forms-followed",
        )
        links = moved.select("word", "root")
        if moved.filter("on").isEmpty():
            return links


def _letter_groups(words: DataFrame) -> dict[str, int]:
    """The group of every letter that occurs in a word, as many rows as the alphabet has letters."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''")
    used = letters.groupBy("c").count()
    load = [0] * GROUPS
    group = {}
    for row in used.orderBy(F.desc("count"), "c").toLocalIterator():
        group[row["c"]] = load.index(min(load))
        load[group[row["c"]]] += row["count"]
    return group


def _vectors(words: DataFrame, group: dict[str, int]) -> DataFrame:
    """``word, n, vec``: how many letters of the word fall in each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(max(map(ord, group), default=0) + 1, np.int64)
        for letter, at in group.items():
            table[ord(letter)] = at
        for batch in batches:
            texts = batch.column("word").to_pylist()
            letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            vec = np.bincount(row * GROUPS + table[letters], minlength=len(texts) * GROUPS).astype(np.int32)
            ends = np.arange(len(texts) + 1, dtype=np.int32) * GROUPS
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(vec))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), lists], ["word", "n", "vec"])

    return words.mapInArrow(count, "word string, n long, vec array<int>")


def _path(depth: Column) -> Column:
    """The first counts of a word as the name of a node."""
    return F.concat_ws(".", F.slice("vec", F.lit(1), depth).cast("array<string>"))


def _nodes(scratch: Scratch, vectors: DataFrame, subtrie: int) -> tuple[DataFrame, DataFrame, int]:
    """Subtries ``depth, path, blocks``, the nodes above them, and the depth of the lowest one."""
    depths = F.explode(F.sequence(F.lit(0), F.lit(GROUPS))).alias("depth")
    leaves = vectors.groupBy("vec").agg(F.count(F.lit(1)).alias("held"))
    each = leaves.select("vec", "held", depths)
    up = _path(F.greatest(F.col("depth") - 1, F.lit(0)))
    each = each.select("depth", _path(F.col("depth")).alias("path"), up.alias("up"), "held")
    nodes = scratch.table(each.groupBy("depth", "path", "up").agg(F.sum("held").alias("held")), "nodes")
    inner = nodes.filter((F.col("held") > subtrie) & (F.col("depth") < GROUPS)).select("depth", "path")
    inner = scratch.table(inner, "inner-nodes")
    above = inner.select((F.col("depth") + 1).alias("depth"), F.col("path").alias("up"))
    below = nodes.join(above, ["depth", "up"], "left_semi").unionByName(nodes.filter("depth = 0"))
    roots = below.filter((F.col("held") <= subtrie) | (F.col("depth") == GROUPS))
    roots = scratch.table(
        roots.select("depth", "path", F.ceil(F.col("held") / subtrie).cast("int").alias("blocks")), "subtries"
    )
    return roots, inner, roots.agg(F.max("depth")).first()[0] or 0


def _search(
    scratch: Scratch, vectors: DataFrame, roots: DataFrame, inner: DataFrame, depth: int, queries: int
) -> DataFrame:
    """``word, n, near, near_n``: every pair of near words, once."""
    at = vectors.select("word", "n", "vec", F.lit(_NONE).alias("spent"), F.lit(0).alias("depth"), F.lit("").alias("path"))
    own = vectors.select("word", "n", "vec")
    arrived, placed = [], []
    for level in range(depth + 1):
        here = roots.filter(F.col("depth") == level).select("path", "blocks")
        arrived.append(at.join(here, "path").withColumn("depth", F.lit(level)))
        placed.append(own.withColumn("path", _path(F.lit(level))).join(here, "path").withColumn("depth", F.lit(level)))
        if level < depth:
            on = at.join(inner.filter(F.col("depth") == level).select("path"), "path", "left_semi")
            at = _step(on, level)
    seek, hold = arrived[0], placed[0]
    for more, words in zip(arrived[1:], placed[1:], strict=True):
        seek, hold = seek.unionByName(more), hold.unionByName(words)
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block")
    hold = hold.select("depth", "path", block, "word", "n", "vec")
    seek = seek.select(
        "depth", "path", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "word", "n", "vec", "spent"
    )
    seek = scratch.table(seek, "searches")
    parts = seek.groupBy("depth", "path", "block").agg(F.ceil(F.count(F.lit(1)) / queries).cast("int").alias("parts"))
    parts = scratch.table(parts, "parts")
    key = ["depth", "path", "block"]
    seek = seek.join(parts, key).withColumn("part", F.pmod(F.xxhash64("word", F.lit(7)), F.col("parts")).cast("int"))
    hold = hold.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = [*key, "part"]
    hold = hold.select(*key, "word", "n", "vec")
    seek = seek.select(*key, "word", "n", "vec", "spent")
    return hold.groupBy(*key).cogroup(seek.groupBy(*key)).applyInArrow(
        _near_words, "word string, n long, near string, near_n long"
    )


def _step(at: DataFrame, level: int) -> DataFrame:
    """The children that a search may visit next, with what it has spent then."""
    count = F.col("vec")[level]
    to = lambda c, spent: F.struct(c.cast("int").alias("c"), F.lit(spent).alias("spent"))
    same = F.array(F.struct(count.cast("int").alias("c"), F.col("spent").alias("spent")))
    free = F.concat(same, F.array(to(count + 1, _SURPLUS), to(count - 1, _DEFICIT)))
    half = F.concat(same, F.array(to(count - 1, _BOTH)))
    moves = F.when(F.col("spent") == _NONE, free).when(F.col("spent") == _SURPLUS, half).otherwise(same)
    moved = at.select("word", "n", "vec", "path", F.explode(moves).alias("m")).filter("m.c >= 0")
    path = F.col("m.c").cast("string") if level == 0 else F.concat_ws(".", "path", F.col("m.c").cast("string"))
    return moved.select("word", "n", "vec", F.col("m.spent").alias("spent"), path.alias("path"), F.lit(level + 1).alias("depth"))


def _near_words(hold: pa.Table, seek: pa.Table) -> pa.Table:
    """The searches of one subtrie, depth first."""
    names = ["word", "n", "near", "near_n"]
    found_q, found_w = [], []
    if hold.num_rows and seek.num_rows:
        table = lambda t: t["vec"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, GROUPS)
        level, held, sought = hold["depth"][0].as_py(), table(hold), table(seek)
        order = np.lexsort(held.T[::-1])
        small = np.int16 if max(held.max(), sought.max()) < 1 << 14 else np.int32
        held, sought = held[order].astype(small), sought.astype(small)
        words, searches = hold["word"].to_pylist(), seek["word"].to_pylist()
        spent = seek["spent"].to_numpy()
        long, first, second = _halves(searches, 0)
        _, first_less, second_less = _halves(searches, 1)
        long_w, first_w, second_w = _halves(words, 0)
        stack = [(0, len(held), level, np.arange(len(sought)), spent)]
        while stack:
            lo, hi, level, who, spent = stack.pop()
            if level == GROUPS or hi - lo <= LEAF:
                for q, w, equal in _leaf(held[lo:hi, level:], sought[who, level:], spent):
                    q, w = who[q], order[lo + w]
                    # One edit leaves the first or the second half as it is.
                    kept = (first[q] == first_w[w]) | (second[q] == second_w[w])
                    less = (first_less[q] == first_w[w]) | (second_less[q] == second_w[w])
                    kept = np.flatnonzero(np.where(long[q] == long_w[w], kept, less))
                    for i, j, same in zip(q[kept].tolist(), w[kept].tolist(), equal[kept].tolist(), strict=True):
                        a, b = searches[i], words[j]
                        if (not same or b < a) and one_edit(a, b):
                            found_q.append(i)
                            found_w.append(j)
                continue
            column = held[lo:hi, level]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [hi - lo]])
            need = sought[who, level]
            for begin, end in zip(starts[:-1], starts[1:], strict=True):
                after = _spend(column[begin] - need, spent)
                goes = after >= 0
                if goes.any():
                    stack.append((lo + begin, lo + end, level + 1, who[goes], after[goes]))
    if not found_q:
        return pa.table([[], [], [], []], schema=pa.schema(
            [("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())]
        ))
    q, w = pa.array(found_q), pa.array(found_w)
    return pa.Table.from_arrays(
        [seek["word"].take(q), seek["n"].take(q), hold["word"].take(w), hold["n"].take(w)], names
    )


def _halves(words: list[str], without: int) -> tuple[np.ndarray, ...]:
    """Lengths, and hashes of both halves of every word, of a word without one letter between them."""
    cut = [(len(w) - without) // 2 for w in words]
    return (
        np.array([len(w) for w in words]),
        np.array([hash(w[:c]) for w, c in zip(words, cut, strict=True)]),
        np.array([hash(w[c + without :]) for w, c in zip(words, cut, strict=True)]),
    )


def _spend(more: np.ndarray, spent: np.ndarray) -> np.ndarray:
    """What is spent after a count that is higher by ``more``; -1 beyond the budget."""
    after = np.where(more == 0, spent, -1)
    after[(more == 1) & (spent == _NONE)] = _SURPLUS
    after[(more == -1) & (spent == _NONE)] = _DEFICIT
    after[(more == -1) & (spent == _SURPLUS)] = _BOTH
    return after


def _leaf(held: np.ndarray, sought: np.ndarray, spent: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Searches and words at a leaf whose other counts agree within the budget, and whether all do."""
    for i in range(0, len(sought), _BLOCK):
        for j in range(0, len(held), _BLOCK // 8):
            more = held[None, j : j + _BLOCK // 8] - sought[i : i + _BLOCK, None]
            moved = np.abs(more).sum(2)
            q, w = np.nonzero(moved <= 2)
            more, moved, state = more[q, w], moved[q, w], spent[i + q]
            up, down = more == 1, more == -1
            fits = (moved == 0) & (state != _SURPLUS)
            fits |= (moved == 1) & down.any(1) & ((state == _NONE) | (state == _SURPLUS))
            if up.shape[1]:
                ordered = up.any(1) & down.any(1) & (up.argmax(1) < down.argmax(1))
                fits |= (moved == 2) & (state == _NONE) & ordered
            if fits.any():
                yield q[fits] + i, w[fits] + j, (moved[fits] == 0) & (state[fits] == _NONE)


def one_edit(a: str, b: str) -> bool:
    """Whether ``a`` becomes ``b`` by one replaced or deleted code point."""
    if len(a) == len(b):
        half = len(a) // 2
        if a[:half] == b[:half]:
            return a != b and _rest(a, b, half, 1)
        return a[half:] == b[half:] and _rest(a, b, 0, 1)
    half = len(b) // 2
    if a[:half] == b[:half]:
        return _rest(a, b, half, 0)
    return a[half + 1 :] == b[half:] and _rest(a, b, 0, 0)


def _rest(a: str, b: str, at: int, skip: int) -> bool:
    end = len(b)
    while at < end and a[at] == b[at]:
        at += 1
    return a[at + 1 :] == b[at + skip :]
