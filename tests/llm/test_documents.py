"""The document operators against brute force, on small fixtures and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import decontaminate, line_dedup, near_dup, poisson_mix, slot_shards, suffix_dedup, toxicity
from textloom.llm.bwt import Merged, ShardBwt, least_by_window
from textloom.llm.scratch import Scratch

VOCABULARY = [a + b for a in "bcdfghklmnprst" for b in ("a", "en", "ir", "ost", "ul")]


def words_of(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def family(rng, size, copies, rate):
    """A text and copies of it in which a share of the words, up to rate, is replaced."""
    base = words_of(rng, size)
    out = [base]
    for _ in range(copies):
        share = rng.random() * rate
        out.append([f"x{rng.random()}" if rng.random() < share else w for w in base])
    return [" ".join(w) for w in out]


def brute_components(rows, width):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if len(w) >= width:
            sets[i] = frozenset(tuple(w[a : a + width]) for a in range(len(w) - width + 1))
        else:
            sets[i] = frozenset([tuple(w)]) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if both and 100 * both >= 80 * (len(x) + len(y) - both):
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("few, width", [(64, 5), (4, 2)])
def test_near_copies(make, monkeypatch, few, width):
    """With FEW at 4 the larger families go through the bounds."""
    monkeypatch.setattr(near_dup, "FEW", few)
    rng = random.Random(5)
    texts = [" ".join(words_of(rng, rng.randint(0, 60))) for _ in range(60)]
    for size, copies, rate in ((120, 40, 0.2), (80, 12, 0.3), (300, 9, 0.1), (20, 6, 0.2)):
        texts += family(rng, size, copies, rate)
    texts += [texts[70], texts[70] + " ", texts[70].upper()]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    found = near_dup.near_duplicates(make(rows), width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_copies_odd(odd, make):
    found = near_dup.near_duplicates(odd, width=2).collect()
    assert len(found) == odd.count()
    by_id = collections.defaultdict(set)
    for r in found:
        by_id[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by_id[1] == {(0, 1, True)} and by_id[3] == {(0, 3, True)}
    assert by_id[5] == {(5000, 4, False)} and by_id[6] == {(1, 6, True)}
    assert all(k for _, _, k in by_id[None])
    left = near_dup.drop_near_duplicates(odd, width=2)
    assert left.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert near_dup.near_duplicates(make([])).collect() == []


def test_slots(make, odd):
    rng = random.Random(1)
    docs = make([(i, "x" * int(rng.paretovariate(1) * 20)) for i in range(3000)])
    placed = slot_shards.assign(docs, 24, cell_rows=1, slots=256).collect()
    held = collections.Counter()
    for r in placed:
        held[r.shard] += r.size
    largest = max(slot_shards.slot_loads(slot_shards.with_slots(docs, slots=256), 256))
    assert max(held.values()) - min(held.values()) <= largest
    for s in held:
        slots = sorted(r.slot for r in placed if r.shard == s)
        assert slots == list(range(len(slots)))
    strange = slot_shards.assign(odd, 3).collect()
    assert len(strange) == 12 and {r.size for r in strange if r.text is None} == {8}
    assert slot_shards.assign(make([]), 24).collect() == []


def test_slots_of_copies(make):
    """An id, a text without an id, or an id with many texts that fills a shard is spread over all of them."""
    docs = [(i, "x" * 40) for i in range(3000)]
    for hot in ([(7, "y" * 40)] * 900, [(None, "z" * 40)] * 900, [(9, f"{i:040}") for i in range(900)], [(5, None)] * 900):
        for cell_rows in (300, 65_536):
            rows = make(docs + hot)
            placed = slot_shards.assign(rows, 8, slots=512, cell_rows=cell_rows).collect()
            assert collections.Counter((r.doc_id, r.text) for r in placed) == collections.Counter(map(tuple, docs + hot))
            held = [sum(r.size for r in placed if r.shard == s) for s in range(8)]
            assert max(held) <= 1.02 * sum(held) / 8
            for s in range(8):
                assert sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed)))
            assert len({r.shard for r in placed if r.doc_id == 3000 - 1}) == 1


def test_slot_map_versions(spark, tmp_path):
    rng = random.Random(2)
    loads = [rng.randint(0, 1000) for _ in range(500)]
    first = slot_shards.first_map(loads, 5)
    more = slot_shards.rebalance(first, loads, 6)
    moved = [s for s in range(500) if first.owners[s] != more.owners[s]]
    assert sum(more.owners[s] == 5 for s in moved) >= len(moved) - 3 and len(moved) < 130
    fewer = slot_shards.rebalance(more, loads, 4)
    assert set(fewer.owners) == {0, 1, 2, 3} and fewer.version == 3
    for m in (first, more, fewer):
        held = [sum(x for x, o in zip(loads, m.owners, strict=True) if o == s) for s in range(m.shards)]
        assert max(held) - min(held) <= 0.02 * sum(held) / m.shards + 1
        m.store(spark, str(tmp_path / "maps"))
    assert slot_shards.SlotMap.load(spark, str(tmp_path / "maps")) == fewer
    assert slot_shards.SlotMap.load(spark, str(tmp_path / "maps"), 2) == more


def test_lines(make, odd):
    rows = [(i, f" Common \nown {i}\ncommon\n" + ("rare" if i < 9 else "")) for i in range(12)]
    found = {r.doc_id: r for r in line_dedup.drop_common_lines(make(rows)).collect()}
    assert found[3].kept_text == "own 3\nrare" and found[3].n_dropped == 2 and found[3].n_lines == 4
    assert found[11].kept_text == "own 11\n"
    kept = {(r.doc_id, r.kept_text) for r in line_dedup.drop_common_lines(odd, min_docs=1).collect()}
    assert kept >= {(1, ""), (2, ""), (3, " \t\n"), (7, ""), (8, "")}
    assert line_dedup.drop_common_lines(make([])).collect() == []


def test_lines_plan(make):
    """The window reuses the range partitioning, and nothing runs in Python."""
    plan = line_dedup.drop_common_lines(make([(1, "a")]))._jdf.queryExecution().toString()
    assert "rangepartitioning(h1" in plan and "hashpartitioning(h1" in plan
    window = plan[plan.index("Window") :]
    assert "Python" not in plan and window.index("rangepartitioning") > 0


def test_mixing(make, odd):
    rows = [(i, "t", "big" if i % 3 else "small") for i in range(6000)]
    mixed = poisson_mix.mix(make(rows), {"big": 1, "small": 3}).collect()
    share = collections.Counter(r.source for r in mixed)
    assert abs(share["small"] / len(mixed) - 0.75) < 0.02 and abs(len(mixed) - 6000) < 250
    per = collections.Counter(r.doc_id for r in mixed)
    assert all(r.copies == per[r.doc_id] and 1 <= r.copy <= r.copies for r in mixed)
    spread = collections.Counter(per[i] for i in range(0, 6000, 3))
    rate = 6000 * 0.75 / 2000
    for k in range(5):
        want = 2000 * np.exp(-rate) * rate**k / np.prod(range(1, k + 1), initial=1)
        assert abs(spread[k] - want) < 5 * want**0.5 + 1
    again = poisson_mix.mix(make(rows).repartition(7), {"big": 1, "small": 3}, broadcast_sources=0)
    assert sorted(map(str, again.collect())) == sorted(map(str, mixed))
    assert {r.source for r in poisson_mix.mix(odd, total=1000).collect()} == {"s", None}
    assert poisson_mix.mix(odd, {"other": 1.0}).collect() == []
    assert poisson_mix.mix(make([])).collect() == []


def test_mixing_small_source(spark, make):
    """A one-row source of a large corpus is repeated as often as its weight asks."""
    many = spark.range(30_000).selectExpr("id AS doc_id", "'t' AS text", "'big' AS source")
    one = make([(-1, "rare", "small"), (-2, "none", None)]).select("doc_id", "text", "source")
    docs = many.unionByName(one)
    rate = 30_002 / 3
    for limit in (poisson_mix.BROADCAST_SOURCES, 0):
        mixed = poisson_mix.mix(docs, broadcast_sources=limit)
        rare = mixed.filter("doc_id < 0").select("doc_id", "copies", "copy", "shuffle_key").collect()
        for i in (-1, -2):
            got = [r for r in rare if r.doc_id == i]
            assert abs(len(got) - rate) < 5 * rate**0.5 and {r.copies for r in got} == {len(got)}
            assert sorted(r.copy for r in got) == list(range(1, len(got) + 1))
        assert len({r.shuffle_key for r in rare}) == len(rare)
    # Sums of draws are Poisson as well: the variance is the rate, so the draws are independent.
    wide = poisson_mix.mix(make([(i, "t") for i in range(300)]), total=300 * 1200)
    n = np.array([r.copies for r in wide.filter("copy = 1").collect()])
    assert len(n) == 300 and abs(n.mean() - 1200) < 10 and 800 < n.var() < 1700


def brute_scan(text, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = word.findall(lower(text))
    hit, ids = set(), set()
    for i, t in items:
        b = word.findall(lower(t))
        n = min(size, len(b))
        grams = {tuple(b[a : a + n]) for a in range(len(b) - n + 1)} if n else set()
        for a in range(len(w) - n + 1):
            if n and tuple(w[a : a + n]) in grams:
                hit.update(range(a, a + n))
                ids.add(i)
    return len(w), len(hit), ids


@pytest.mark.parametrize("limit", [100_000, 0])
def test_benchmark(spark, make, odd, limit):
    rng = random.Random(3)
    items = [(i, " ".join(words_of(rng, rng.choice([0, 1, 3, 10, 14, 30])))) for i in range(12)]
    items += [(12, None), (13, items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i in range(40):
        body = words_of(rng, 30)
        source = (items[rng.randrange(12)][1] or "").split()
        rows.append((i, " ".join(body[:15]) + " " + "; ".join(source[:11]).upper() + " " + " ".join(body[15:])))
    found = decontaminate.scan(make(rows), bench, broadcast_windows=limit).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, set(r["items"])) for r in found}
    assert got == {i: brute_scan(t, items) for i, t in rows}
    strange = decontaminate.scan(odd, bench, broadcast_windows=limit).collect()
    assert len(strange) == 12 and all(r.n_words == 0 for r in strange if r.doc_id in (1, 2, 3))
    none = decontaminate.scan(make(rows), bench.filter("false"), broadcast_windows=limit)
    assert {r.n_hit for r in none.collect()} == {0}
    assert decontaminate.scan(make([]), bench, broadcast_windows=limit).collect() == []


def test_benchmark_removal(spark, make):
    bench = spark.createDataFrame([(1, "a b c"), (2, "c d")], "item_id long, text string")
    docs = make([(1, "(x) A, b; c d. y"), (2, "clean"), (3, None), (4, "a b c"), (None, "c d")])
    left = decontaminate.remove_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 2, 3]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut == {1: "(x) y", 2: "clean", 3: None, 4: "", None: "c d"}


def brute_repeats(rows, length):
    first, out = {}, {}
    known = sorted((i, (t or "").encode()) for i, t in rows if i is not None)
    for i, b in known:
        for a in range(len(b) - length + 1):
            first.setdefault(b[a : a + length], i)
    for i, b in known:
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - length + 1):
            if first[b[a : a + length]] < i:
                gone[a : a + length] = True
        out.setdefault(i, []).append(bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("hot", [256, 2])
def test_repeats(spark, make, monkeypatch, hot):
    """Small units and runs, so that many shards merge; with hot at 2, anchors are split."""
    for name, value in (("UNIT", 600), ("RUN", 3000), ("SHARD", 500)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(4)
    passages = [" ".join(words_of(rng, 25)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(words_of(rng, rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, 30)
            parts += [p[a : a + rng.randint(20, 120)], " ".join(words_of(rng, 5))]
        rows.append((i, "ü".join(parts)))
    rows += [(60, "a" * 300), (61, "b" + "a" * 200), (62, rows[7][1]), (62, rows[7][1]), (None, rows[7][1])]
    rows += [(63, None), (64, ""), (65, "short"), (-1, rows[9][1][5:])]
    rng.shuffle(rows)
    scratch = Scratch(spark, "test")
    cut = suffix_dedup.removals(make(rows), scratch, bucket_bytes=1500, hot_units=hot).collect()
    scratch.close()
    got = collections.defaultdict(list)
    for r in cut:
        assert len(bytes(r.kept)) + sum(s.len for s in r.spans) == r.n_bytes
        if r.doc_id is not None:
            got[r.doc_id].append(bytes(r.kept))
        else:
            assert not r.spans
    assert dict(got) == brute_repeats(rows, 50)


def test_repeats_empty(spark, make):
    scratch = Scratch(spark, "test")
    assert suffix_dedup.removals(make([]), scratch).collect() == []


def test_bwt_merge():
    rng = random.Random(1)
    for _ in range(60):
        alphabet = rng.choice(["ab", "abc", "a", "\x00ÿ"])
        depth = rng.randint(1, 8)
        text = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 20))).encode("latin1")  # noqa: E731,B023
        shards = [[text() for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 5))]
        owners = [[rng.randint(-5, 50) for _ in s] for s in shards]
        least = {}
        for s, o in zip(shards, owners, strict=True):
            for t, w in zip(s, o, strict=True):
                for i in range(len(t) - depth + 1):
                    least[t[i : i + depth]] = min(least.get(t[i : i + depth], 99), w)
        want = [[[least[t[i : i + depth]] for i in range(len(t) - depth + 1)] for t in s] for s in shards]
        got = [[v.tolist() for v in s] for s in least_by_window(shards, owners, depth)]
        assert got == want
        merged = Merged([ShardBwt(s) for s in shards], depth)
        tails = [s[i][a:] for s in shards for b in [ShardBwt(s)] for i, a in zip(b.string, b.offset, strict=True)]
        order = [None] * len(tails)
        for j, at in enumerate(merged.at):
            order[at] = tails[j]
        for i in range(1, len(order)):
            x, y, n = order[i - 1], order[i], 0
            while n < min(len(x), len(y), depth) and x[n] == y[n]:
                n += 1
            assert merged.lcp[i] == n


def test_toxicity(spark, make, odd):
    rng = random.Random(6)
    bad = ["gruesome", "vile", "rotten", "wretch"]
    rows, labels = [], []
    for i in range(600):
        w = words_of(rng, rng.randint(20, 120))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = make(rows)
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, labelled)
    truth = dict(labels)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    unseen = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    held = {r.doc_id for r in docs.filter(toxicity.held_out("doc_id")).collect()}
    assert held == set(unseen)
    assert np.mean([(scores[i] >= 0.5) == truth[i] for i in unseen]) >= 0.95
    # Labels of held-out rows have no say.
    flipped = labelled.withColumn(
        "toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    other = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, flipped)).collect()}
    assert other == scores
    strange = toxicity.score(odd, model).collect()
    assert len(strange) == 12 and all(0 <= r.score <= 1 for r in strange)
    left = toxicity.reject_toxic(odd, model)
    assert left.columns == odd.columns and left.count() <= 12
    assert toxicity.score(make([]), model).collect() == []
    none = toxicity.fit(make([]), labelled)
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}


def test_kept_hash(make):
    kept = line_dedup.drop_common_lines(make([(1, None)])).select(F.sha2(F.col("kept_text"), 256))
    assert kept.first()[0] == hashlib.sha256(b"").hexdigest()
