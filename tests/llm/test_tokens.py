"""Two tokenizers aligned: against the models themselves, occurrence by occurrence."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from textloom.llm import token_align
from textloom.llm.queries import QUERIES
from textloom.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def models():
    a = tokenizers.Tokenizer.from_file(f"{token_align.TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{token_align.TOKENIZERS}/piece_bpe_32k.model")
    return a, b


def spans(pieces):
    ends = np.cumsum([len(p) for p in pieces])
    return [(int(e) - len(p), int(e)) for p, e in zip(pieces, ends, strict=True)]


def brute(models, texts):
    """Rows of the contract, from all pairs of tokens in a group."""
    a, b = models
    chars = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(c): c for c in chars}
    byte_of.update({chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in chars)})
    docs = []
    for text in texts:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode([text])[0] if text else []
        pa = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ia]
        pb = [
            bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
            for p in map(b.id_to_piece, ib)
        ]
        if not text or b"".join(pa) != (" " + text).encode() or b"".join(pb) != (" " + text).encode():
            docs.append(None)
            continue
        sa, sb = spans(pa), spans(pb)
        groups, links, done_a, done_b = [], [], 0, 0
        for cut in sorted({e for _, e in sa} & {e for _, e in sb}):
            ga = [i for i in range(done_a, len(sa)) if sa[i][1] <= cut] if len(sa) < 500 else None
            if ga is None:
                end_a, end_b = done_a, done_b
                while end_a < len(sa) and sa[end_a][1] <= cut:
                    end_a += 1
                while end_b < len(sb) and sb[end_b][1] <= cut:
                    end_b += 1
                ga, gb = list(range(done_a, end_a)), list(range(done_b, end_b))
            else:
                gb = [j for j in range(done_b, len(sb)) if sb[j][1] <= cut]
            done_a, done_b = ga[-1] + 1, gb[-1] + 1
            groups.append(",".join(str(ia[i]) for i in ga) + "|" + ",".join(str(ib[j]) for j in gb))
            links += [(ia[i], ib[j]) for i in ga for j in gb if sa[i][0] < sb[j][1] and sb[j][0] < sa[i][1]]
        docs.append((len(ia), len(ib), groups, links))
    held, top = {}, {}
    for d in docs:
        for pair in set(d[3]) if d else ():
            held[pair] = held.get(pair, 0) + 1
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, "", 0, 0))
            continue
        digest = hashlib.sha256(";".join(d[2]).encode()).hexdigest()
        best = sum(held[p] == top[p[0]] for p in d[3])
        out.append((d[0], d[1], len(d[2]), len(d[3]), digest, best, sum(held[p] for p in d[3])))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def test_query(spark, models):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    found = QUERIES["op13_token_align"](spark, SF).orderBy("doc_id").collect()
    assert [r.doc_id for r in found] == [r.doc_id for r in rows]
    assert [tuple(r[c] for c in COLUMNS) for r in found] == brute(models, [r.text for r in rows])
    assert sum(r.n_best for r in found) > 0


@pytest.mark.parametrize("limit", [0, 10**6])
def test_odd(spark, models, make, limit):
    """Both ways to look up counts; nulls, empty and blank texts, special strings, a long text, copies."""
    texts = [
        None, "", " ", "  a  b", "one two", "one two", "<|endoftext|> <s> <0x41>", "日本語 ünï\n\n\t€ 🙂‍🙂",
        "▁under", "xq" * 3000, "I'll 'S we're\r\n", "word " * 30_000, "\x00\x7f", "1" * 50,
    ]
    docs = make([(i if i != 3 else None, t) for i, t in enumerate(texts)])
    docs = docs.unionByName(docs.filter("doc_id = 4"))
    docs = docs.withColumns({c: F.lit("x") for c in ("id", "pair", "n_a", "groups", "times", "held")})
    scratch = Scratch(spark, "test")
    vocabularies = token_align.files(spark)
    aligned = scratch.table(token_align.align(docs, vocabularies), "aligned")
    found = token_align.with_link_counts(aligned, scratch, token_align.size_b(vocabularies), limit)
    found = found.withColumn("groups_sha256", F.expr("if(n_a > 0, sha2(groups, 256), '')"))
    got = sorted((tuple(r) for r in found.select("doc_id", *COLUMNS).collect()), key=repr)
    want = brute(models, [*texts, texts[4]])
    ids = [i if i != 3 else None for i in range(len(texts))] + [4]
    assert got == sorted(((i, *w) for i, w in zip(ids, want, strict=True)), key=repr)
    assert dict((r[0], r[1]) for r in got)[8] == 0  # its bytes do not come back


def test_empty(spark, make):
    scratch = Scratch(spark, "test")
    vocabularies = token_align.files(spark)
    aligned = scratch.table(token_align.align(make([]), vocabularies), "aligned")
    assert token_align.with_link_counts(aligned, scratch, 32000).collect() == []


def test_shared_cuts():
    """Against the intersection, on random ends and a long stretch without a cut."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        docs, base, ea, eb, bounds, want = rng.integers(1, 5), 0, [], [], [], []
        for _ in range(docs):
            size = int(rng.integers(2, 60))
            x, y = (np.flatnonzero(rng.random(size - 1) < rng.random()) + 1 + base for _ in "ab")
            bounds.append((len(ea), len(ea) + len(x), len(eb), len(eb) + len(y)))
            base += size
            want += sorted(set(x.tolist()) & set(y.tolist()))
            ea += [*x, base]
            eb += [*y, base]
        ea, eb = np.array(ea), np.array(eb)
        at_a, at_b = token_align.shared_cuts(ea, eb, *map(np.array, zip(*bounds, strict=True)))
        assert ea[at_a].tolist() == want and eb[at_b].tolist() == want
    ea, eb = np.arange(1, 20_001) * 2, np.append(np.arange(1, 20_000) * 2 + 1, 40_000)
    one = lambda v: np.array([v])
    at_a, _ = token_align.shared_cuts(ea, eb, one(0), one(len(ea) - 1), one(0), one(len(eb) - 1))
    assert at_a.tolist() == []
