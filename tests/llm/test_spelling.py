"""Words one edit apart: against all pairs, with subtries, parts and blocks of a few words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from textloom.llm import spelling
from textloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def counted(rows, mutate=31):
    held = Counter()
    for doc, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if mutate and h % mutate == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            held[run] += 1
    return {w: n for w, n in held.items() if w}


def brute(words, ratio=10):
    """Near words by deleted letters; ``*`` marks the place, so equal keys are one edit apart."""
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
        for i in range(len(w) + 1):
            holes[w[:i] + "*" + w[i:]].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for a in group:
            near[a] |= group - {a}
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = [form, n, len(near[w]), words[form] if form else None]
    rows = []
    for w, (form, n, count, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, count, form_n))
    return sorted(rows)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = {w: n for w, n in counted(rows).items() if len(w) >= 7 and n >= 2}
    got = QUERIES["op11_spelling_trie"](spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found(got) == brute(words)
    assert any(r[1] for r in brute(words))


@pytest.mark.parametrize(("subtrie", "queries"), [(10_000, 10_000), (40, 10_000), (3, 5)])
def test_variants(spark, subtrie, queries):
    """Chains of forms, words of equal letters, hot nodes and leaves, letters outside ASCII, a long word."""
    rng = random.Random(4)
    words = {}
    for _ in range(25):
        base = "".join(rng.choice("aeinrtsßé") for _ in range(rng.randint(3, 9)))
        words[base] = rng.choice([3, 500])
        for _ in range(12):
            w, i = list(base), rng.randrange(len(base))
            kind = rng.randrange(3)
            w[i : i + (kind < 2)] = [rng.choice("aeinrtsßé")] if kind else []
            words["".join(w)] = rng.choice([1, 2, 2, 40, 5000])
    words |= {"".join(rng.sample("abcdefg", 7)): 2 for _ in range(120)}  # one leaf
    words |= {"x" * 3000: 2, "x" * 3001: 30, "x" * 1500 + "y" + "x" * 1499: 3, "a": 1, "b": 10, "ab": 100, "ÿ": 2}
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    assert found(spelling.variants(df, subtrie=subtrie, queries=queries)) == brute(words)


def test_counts(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    rows += [(20, "Ñandú ÑANDÚ ×÷ d'accord naïve_x A1B2 " * 40), (21, "ſtraße K İ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for mutate in (31, 2, 0):
        got = {r.word: r.n for r in spelling.word_counts(docs, mutate=mutate).collect()}
        assert got == counted(rows, mutate)
    assert spelling.word_counts(docs.filter("false")).collect() == []
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(empty).collect() == []
    odd_words = spark.createDataFrame([(None, 3), ("", 2), ("a", 1)], "word string, n long")
    assert sorted(map(repr, found_odd(odd_words))) == sorted(
        map(repr, [(None, None, None, 3, 0, None), ("", None, "", 2, 0, None), ("a", None, "a", 1, 0, None)])
    )


def found_odd(df):
    return [tuple(r) for r in spelling.variants(df).collect()]


def test_one_edit():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 7)))
        b = "".join(rng.choice("ab") for _ in range(len(a) - rng.randint(0, 1)))
        swaps = {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "ab"} - {a}
        drops = {a[:i] + a[i + 1 :] for i in range(len(a))}
        assert spelling.one_edit(a, b) == (b in (swaps if len(a) == len(b) else drops)), (a, b)
