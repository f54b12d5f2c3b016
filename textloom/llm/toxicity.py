"""Toxicity by compression distance: two zstandard dictionaries and calibrated thresholds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.near_dup import shingle_hashes, subkeys

FIT_ROWS = 8000  # labelled rows at most, picked by a hash of their id
CALIBRATION_ROWS = 1500  # of each half, scored with the dictionaries of the other
WINDOW = 8  # words compressed together
ORDINARY_BYTES = 32_768
TOXIC_BYTES = 32_768
THRESHOLDS = range(1, 8)  # bytes saved
COPY_KEYS = 12
FIT_BYTES = 64 << 20  # of labelled texts at most, in the order of the same hash
SIGN_ROWS = 128  # labelled texts signed at a time


def windows(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, WINDOW at a time; one empty window for none."""
    words = (text or b"").lower().split()
    return [
        b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)
    ] or [b""]


def _trained(size: int, samples: list[bytes]) -> bytes:
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: their own text
        return b"".join(dict.fromkeys(samples))[-size:]


def train(rows: list[tuple[bytes, int]]) -> tuple[bytes, bytes]:
    """Dictionaries for toxic and for ordinary text.

    Near copies count once. The toxic samples are the toxic texts without the
    words that ordinary texts use as well, so that the dictionary holds what
    tells them apart; it ends in the ordinary one, so that a window of ordinary
    words finds the same matches at the same distance in both.
    """
    seen: set[tuple[int, int, int]] = set()
    kept: list[tuple[bytes, int]] = []
    for i in range(0, len(rows), SIGN_ROWS):
        some = [(t, label, shingle_hashes(t, 2)) for t, label in rows[i : i + SIGN_ROWS]]
        some = [x for x in some if len(x[2])]
        signs = subkeys([x[2] for x in some])[:, :COPY_KEYS] if some else []
        for (text, label, _), sign in zip(some, signs, strict=True):
            marks = {(label, j, int(k)) for j, k in enumerate(sign)}
            if not marks & seen:
                kept.append((text, label))
            seen |= marks
    toxic, ordinary = Counter(), Counter()
    for text, label in kept:
        (toxic if label else ordinary).update(set(text.lower().split()))
    bad = sum(label for _, label in kept)
    good = len(kept) - bad
    least = max(3, 0.01 * bad)
    telling = {
        w for w, n in toxic.items()
        if n >= least and (n - 1) / bad >= 8 * (ordinary[w] + 0.5) / max(good, 1)
    }
    toxic_samples = [
        b" " + b" ".join(w for w in text.lower().split() if w in telling) + b" "
        for text, label in kept if label
    ]
    plain = [w for text, label in kept[:3000] if not label for w in windows(text)]
    size = max(1024, min(TOXIC_BYTES, 3 * sum(len(w) + 1 for w in telling) // 2))
    base = _trained(ORDINARY_BYTES, plain)
    return _trained(size, toxic_samples) + base, base


class Scorer:
    """Bytes that the toxic dictionary saves on each window, against the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(
            9, source_size=80, dict_size=ORDINARY_BYTES + 4096, min_match=4,
            write_content_size=0, write_checksum=0, write_dict_id=0,
        )

        def compressor(raw: bytes) -> zstandard.ZstdCompressor:
            words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(dict_data=words, compression_params=params)

        self.toxic, self.ordinary = compressor(toxic).compress, compressor(ordinary).compress

    def saved(self, text: bytes | None) -> np.ndarray:
        toxic, ordinary = self.toxic, self.ordinary
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)])

    def features(self, text: bytes | None) -> list[float]:
        """For each threshold, the share and the number of windows that reach it."""
        saved = self.saved(text)
        reached = [int(np.count_nonzero(saved >= t)) for t in THRESHOLDS]
        return [np.log1p(1000 * n / len(saved)) for n in reached] + [np.log1p(n) for n in reached]


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float | None = None  # the score of every text, where only one label was seen

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        scorer = Scorer(self.toxic, self.ordinary)
        rows = np.array([scorer.features(t) for t in texts]).reshape(len(texts), -1)
        return self._logistic(rows)

    def _logistic(self, rows: np.ndarray) -> np.ndarray:
        z = (rows - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit_rows(rows: list[tuple[bytes, int]]) -> Model:
    """Dictionaries from all rows; thresholds calibrated on halves that did not train theirs."""
    labels = [label for _, label in rows]
    none = np.zeros(0)
    if len(set(labels)) < 2 or len(rows) < 20:
        return Model(b"", b"", none, none, none, constant=float(np.mean(labels)) if labels else 0.0)
    feats, seen = [], []
    for own, other in ((rows[::2], rows[1::2]), (rows[1::2], rows[::2])):
        scorer = Scorer(*train(own))
        for text, label in other[:CALIBRATION_ROWS]:
            feats.append(scorer.features(text))
            seen.append(label)
    x, y = np.array(feats), np.array(seen, float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = z.T @ (z * (p * (1 - p))[:, None]) + np.eye(len(w))
        w -= np.linalg.solve(curve, z.T @ (p - y) + w)
    return Model(*train(rows), mean, scale, w)


def held_out(id_col: str) -> F.Column:
    """Rows whose labels are never used: a fifth of all ids."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % 5) == 0


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", fit_rows_max: int = FIT_ROWS, fit_bytes_max: int = FIT_BYTES,
) -> Model:
    """Learn from at most ``fit_rows_max`` labelled documents that are not held out.

    They are chosen by a hash of the id among the labels, and only their texts
    are fetched, in that order until they hold ``fit_bytes_max`` bytes. An id with several labels counts as toxic if one says so.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.filter(~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(fit_rows_max)
    side = F.broadcast(chosen.withColumnRenamed(id_col, "__id"))  # fit_rows_max rows at most
    found = docs.join(side, docs[id_col] == F.col("__id")).select(
        "__id", F.col(text_col).cast("binary").alias("text"), F.col("__label").cast("int").alias("y")
    )
    order = [F.xxhash64("__id"), F.col("__id"), F.col("text")]
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    few = found.orderBy(*order).limit(fit_rows_max).withColumn("__bytes", so_far)
    rows = few.filter(F.col("__bytes") <= fit_bytes_max).orderBy("__bytes", *order).select("text", "y").collect()
    return fit_rows([(bytes(r["text"] or b""), r["y"]) for r in rows])


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, score`` for every row: the probability of label 1, from the whole text alone.

    Null, empty and blank texts are one empty window and get the score of a text
    that saves nothing. Rows that repeat get equal scores. Other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = model.scores(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(found, pa.float64())], ["id", "score"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = source.mapInArrow(run, f"id {kind}, score double")
    return out.withColumnRenamed("id", id_col)


def reject_toxic(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5
) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, unchanged and without a shuffle."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = batch.schema.get_field_index(text_col)
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array(model.scores(texts) < limit))

    return docs.select(*names).mapInArrow(run, docs.schema)
