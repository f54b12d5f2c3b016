"""Two tokenizers over the same bytes: groups between shared cuts, and how often ids meet."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import Scratch

TOKENIZERS = "/opt/tokenizers"
BATCH_BYTES = 1 << 20  # of text aligned together
COUNT_PAIRS = 1 << 22  # id pairs counted together
BROADCAST_PAIRS = 4_000_000  # counted id pairs that are broadcast, 17 bytes each; joined beyond

# The pre-tokenizer pattern of the byte-level model, and its 256 byte characters.
_PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

_ALIGNED = (
    "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
)


class ByteLevel:
    """A byte-level model, from its json file.

    Where merges come in the order of their ids, as they do in models trained
    that way, ranks give the same tokens and a faster encoder runs.
    """

    def __init__(self, raw: bytes):
        model = json.loads(raw)["model"]
        special = {t["content"] for t in json.loads(raw).get("added_tokens", [])}
        other = iter(range(256, 512))
        plain = set(_PLAIN_BYTES)
        byte_of = {chr(b if b in plain else next(other)): b for b in range(256)}
        self.bytes_of = [b""] * (max(model["vocab"].values()) + 1)
        for token, at in model["vocab"].items():
            if token not in special:
                self.bytes_of[at] = bytes(byte_of[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.slow = tokenizers.Tokenizer.from_buffer(raw)
        self.slow.encode_special_tokens = True
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"]["".join(pair)] for pair in pairs]
        self.fast = None
        if order == sorted(order):
            ranks = {b: i for i, b in enumerate(self.bytes_of) if b}
            self.fast = tiktoken.Encoding(
                "byte-level", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return [
                np.array(self.slow.encode(t, add_special_tokens=False).ids, np.int64) for t in texts
            ]
        plain = {"allowed_special": set(), "disallowed_special": ()}
        return [self.fast.encode_to_numpy(t, **plain) for t in texts]


class Pieces:
    """A sentencepiece model; it adds the space before the text itself."""

    def __init__(self, raw: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p)
            else p.replace("▁", " ").encode()
            for p in map(self.model.id_to_piece, range(self.model.vocab_size()))
        ]
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def _loaded(raw_a: bytes, raw_b: bytes) -> tuple[ByteLevel, Pieces, list[str]]:
    a, b = ByteLevel(raw_a), Pieces(raw_b)
    ids = [str(i) for i in range(max(len(a.lengths), len(b.lengths)))]
    na, nb = len(a.lengths), len(b.lengths)
    # Every id with the mark that may follow it: inside and at the end of a group, for A and for B.
    marked = [i + "," for i in ids[:na]] + [i + "|" for i in ids[:na]]
    return a, b, marked + [i + "," for i in ids[:nb]] + [i + ";" for i in ids[:nb]]


def files(spark, folder: str = TOKENIZERS, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> Broadcast:
    """The two vocabulary files, read by the driver (about 2 MB) and sent to every executor."""
    raw = []
    for name in (a, b):
        with open(os.path.join(folder, name), "rb") as f:
            raw.append(f.read())
    return spark.sparkContext.broadcast(tuple(raw))


def size_b(vocabularies: Broadcast) -> int:
    """The size of B's vocabulary, by which ``pairs`` come apart."""
    return len(Pieces(vocabularies.value[1]).lengths)


def shared_cuts(
    ea: np.ndarray, eb: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ea`` and ``eb`` of the ends that both hold, by divide and conquer.

    ``ea[a0:a1]`` and ``eb[b0:b1]`` are the ends inside the intervals, in order
    over all of them. In every interval the end of A nearest to the middle that
    a bisection of ``eb`` finds becomes a cut, and both halves are treated
    alike; all intervals take a step at once. An interval without a cut is left
    as it is: a group.
    """
    at_a, at_b = [], []
    while len(a0):
        open_ = (a0 < a1) & (b0 < b1)
        a0, a1, b0, b1 = a0[open_], a1[open_], b0[open_], b1[open_]
        middle = (a0 + a1) >> 1
        cut_a = np.full(len(a0), -1)
        cut_b = np.full(len(a0), -1)
        todo, step = np.arange(len(a0)), 0
        while len(todo):
            probe = middle[todo] + ((step + 1) >> 1 if step & 1 else -(step >> 1))
            inside = (probe >= a0[todo]) & (probe < a1[todo])
            if step & 1 == 0 and not inside.all():  # past the lower edge; the upper one is no further
                past = ~inside & (middle[todo] + (step >> 1) + 1 >= a1[todo])
                todo, probe, inside = todo[~past], probe[~past], inside[~past]
            ends = ea[np.where(inside, probe, a0[todo])]
            place = np.searchsorted(eb, ends)
            met = inside & (place < b1[todo])
            met &= eb[np.minimum(place, len(eb) - 1)] == ends
            cut_a[todo[met]], cut_b[todo[met]] = probe[met], place[met]
            todo, step = todo[~met], step + 1
        cut = cut_a >= 0
        a0, a1, b0, b1, cut_a, cut_b = a0[cut], a1[cut], b0[cut], b1[cut], cut_a[cut], cut_b[cut]
        at_a.append(cut_a)
        at_b.append(cut_b)
        # The halves in order, so that places in the next step ascend.
        a0, a1 = _woven(a0, cut_a + 1), _woven(cut_a, a1)
        b0, b1 = _woven(b0, cut_b + 1), _woven(cut_b, b1)
    if not at_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.sort(np.concatenate(at_a)), np.sort(np.concatenate(at_b))


def _woven(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.stack([first, second], 1).ravel()


def _aligned(a: ByteLevel, b: Pieces, marked: list[str], texts: list[str | None]) -> list[pa.Array]:
    """The columns of _ALIGNED for some texts."""
    n = len(texts)
    has = [i for i, t in enumerate(texts) if t]
    spaced = [" " + texts[i] for i in has]
    of_a, of_b = a.encode(spaced), b.encode([texts[i] for i in has])
    docs, ids_a, ids_b = [], [], []
    for i, text, x, y in zip(has, spaced, of_a, of_b, strict=True):
        raw = text.encode()
        if int(a.lengths[x].sum()) == len(raw) and b"".join(map(b.bytes_of.__getitem__, y)) == raw:
            docs.append(i)
            ids_a.append(x)
            ids_b.append(np.array(y, np.int64))
    out = {k: np.zeros(n, np.int64) for k in ("a", "b", "groups", "links", "pairs")}
    texts_out = [""] * n
    keys = times = np.empty(0, np.int64)
    if docs:
        na, nb = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        fa, fb = np.concatenate(ids_a).astype(np.int64), np.concatenate(ids_b)
        ea, eb = np.cumsum(a.lengths[fa]), np.cumsum(b.lengths[fb])
        last_a, last_b = np.cumsum(na), np.cumsum(nb)
        cut_a, cut_b = shared_cuts(ea, eb, last_a - na, last_a - 1, last_b - nb, last_b - 1)
        # The last end of a document is shared as well and closes its last group.
        ends_a, ends_b = np.zeros(len(fa), bool), np.zeros(len(fb), bool)
        ends_a[cut_a] = ends_a[last_a - 1] = True
        ends_b[cut_b] = ends_b[last_b - 1] = True
        doc_a, doc_b = np.repeat(np.arange(len(docs)), na), np.repeat(np.arange(len(docs)), nb)
        groups = np.bincount(doc_a[ends_a], minlength=len(docs))
        # Every end, counted once where shared, closes the overlap of just one pair of tokens.
        own = np.flatnonzero(~ends_a)
        link_a = np.concatenate([own, np.searchsorted(ea, eb)])
        link_b = np.concatenate([np.searchsorted(eb, ea[own]), np.arange(len(fb))])
        width = len(b.lengths)
        found = np.sort((doc_b[link_b] * len(a.lengths) + fa[link_a]) * width + fb[link_b])
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        times = np.diff(np.append(first, len(found)))
        found = found[first]
        of_doc, keys = np.divmod(found, len(a.lengths) * width)
        # Tokens of A and B in the order of the groups, each with the mark that follows it.
        done_a = np.concatenate([[0], np.cumsum(ends_a)[:-1]])
        done_b = np.concatenate([[0], np.cumsum(ends_b)[:-1]])
        start_b = np.concatenate([[0], np.flatnonzero(ends_b) + 1])
        stop_a = np.flatnonzero(ends_a) + 1
        order = np.empty(len(fa) + len(fb), np.int64)
        order[np.arange(len(fa)) + start_b[done_a]] = fa + len(a.lengths) * ends_a
        order[np.arange(len(fb)) + stop_a[done_b]] = fb + width * ends_b + 2 * len(a.lengths)
        edges = np.concatenate([[0], last_a + last_b])
        for k, i in enumerate(docs):
            codes = order[edges[k] : edges[k + 1]].tolist()
            texts_out[i] = "".join(map(marked.__getitem__, codes))[:-1]
        out["a"][docs], out["b"][docs], out["groups"][docs] = na, nb, groups
        out["links"][docs] = na + nb - groups
        out["pairs"][docs] = np.bincount(of_doc, minlength=len(docs))
    at = pa.array(np.concatenate([[0], np.cumsum(out["pairs"])]).astype(np.int32))
    return [
        *(pa.array(out[k]) for k in ("a", "b", "groups", "links")),
        pa.array(texts_out, pa.string()),
        pa.ListArray.from_arrays(at, pa.array(keys, pa.int64())),
        pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32))),
    ]


def align(docs: DataFrame, vocabularies: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with the alignment of its two token sequences.

    Returns ``id, n_a, n_b, n_groups, n_links, groups, pairs, times``. ``groups``
    is the alignment as text, ``a1,a2|b1;a3|b2,b3``: between two byte offsets at
    which tokens of both sides end, the ids of A and those of B. ``pairs`` are
    the distinct linked id pairs, as A id * size of B + B id, and ``times`` how
    often each is linked. Tokens are linked if their byte ranges overlap.

    A encodes a space and the text, B the text, before which it puts a space
    itself; strings of special tokens are plain text. Texts that are null or
    empty, and texts whose tokens do not give back their bytes, have no tokens:
    zeros, '' and empty lists. Rows that repeat are aligned each for itself.
    Other columns are ignored.
    """
    names = ["id", *(c.split()[0] for c in _ALIGNED.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, marked = _loaded(*vocabularies.value)
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            begin = held = 0
            for i in range(batch.num_rows + 1):
                size = texts[i].as_buffer().size if i < batch.num_rows and texts[i].is_valid else 0
                if i == batch.num_rows or (held and held + size > BATCH_BYTES):
                    part = _aligned(a, b, marked, texts.slice(begin, i - begin).to_pylist())
                    if i > begin:
                        yield pa.RecordBatch.from_arrays([ids.slice(begin, i - begin), *part], names)
                    begin, held = i, 0
                held += size

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(run, f"id {kind}, {_ALIGNED}")
    return out.withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``pair, held, best``: the rows that hold each pair, and whether no pair of its A id is in more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("pairs").flatten().to_numpy()
            for i in range(0, len(flat), COUNT_PAIRS):
                pair, held = np.unique(flat[i : i + COUNT_PAIRS], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(held)], ["pair", "held"])

    counted = aligned.select("pairs").mapInArrow(count, "pair long, held long")
    counted = counted.groupBy("pair").agg(F.sum("held").alias("held"))
    a = F.floor(F.col("pair") / size_b).alias("a")
    top = counted.groupBy(a).agg(F.max("held").alias("top"))
    return counted.join(top, F.floor(counted["pair"] / size_b) == top["a"]).select(
        "pair", "held", (F.col("held") == F.col("top")).alias("best")
    )


def with_link_counts(
    aligned: DataFrame, scratch: Scratch, size_b: int, broadcast_max: int = BROADCAST_PAIRS
) -> DataFrame:
    """``aligned``, a written table, with ``n_best, count_sum`` instead of ``pairs, times``.

    The count of a link is the number of rows that hold its id pair. ``n_best``
    are the links whose count is the highest of their A id, ties included;
    ``count_sum`` adds up the counts of all links. Rows without links get 0.
    Up to ``broadcast_max`` counted pairs are sent to the tasks; more are joined.
    """
    counts = scratch.table(pair_counts(aligned, size_b), "pair-counts")
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    if counts.count() > broadcast_max:
        rows = scratch.table(aligned.withColumn("__row", F.monotonically_increasing_id()), "numbered")
        each = rows.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
        each = each.select("__row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("t"))
        sums = each.join(counts, "pair").groupBy("__row").agg(
            F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("n_best"),
            F.sum(F.col("t") * F.col("held")).alias("count_sum"),
        )
        found = rows.join(sums, "__row", "left")
        return found.select(*kept, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")))
    sent = counts.orderBy("pair").toArrow()
    table = aligned.sparkSession.sparkContext.broadcast(
        tuple(sent.column(c).to_numpy() for c in ("pair", "held", "best"))
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, best = table.value
        for batch in batches:
            lists = batch.column("pairs")
            sums = np.zeros((2, batch.num_rows), np.int64)
            begin = 0
            while begin < batch.num_rows:  # rows with about COUNT_PAIRS pairs at a time, one at least
                at = np.asarray(lists.offsets)
                end = max(begin + 1, int(np.searchsorted(at, at[begin] + COUNT_PAIRS, "right")) - 1)
                at = at[begin : end + 1]
                flat = lists.values.to_numpy()[at[0] : at[-1]]
                times = batch.column("times").values.to_numpy()[at[0] : at[-1]].astype(np.int64)
                place = np.searchsorted(pair, flat)
                for k, x in enumerate((times * best[place], times * held[place])):
                    total = np.concatenate([[0], np.cumsum(x)])
                    sums[k, begin:end] = np.diff(total[at - at[0]])
                begin = end
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sums)], [*kept, "n_best", "count_sum"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name in kept)
    return aligned.mapInArrow(look_up, f"{schema}, n_best long, count_sum long")
