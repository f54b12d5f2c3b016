"""Token lists as small binaries, for shuffles: about a tenth of the bytes of a list of records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_TYPE = T.ArrayType(
    T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)
ARROW_TYPE = pa.list_(pa.struct([("token", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
FRAME_BYTES = 8 << 20  # of unpacked tokens that are held at one time
FRAME_TOKENS = 1 << 16  # that are packed at one time, besides one long list

_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def _small(values: np.ndarray) -> bytes:
    """The number of bytes of each value, and the values."""
    least, most = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    kind = next(w for w in _WIDTHS if np.iinfo(w).min <= least and most <= np.iinfo(w).max)
    return bytes([_WIDTHS.index(kind)]) + values.astype(kind).tobytes()


def _large(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    kind = np.dtype(_WIDTHS[raw[at]])
    end = at + 1 + n * kind.itemsize
    return np.frombuffer(raw, kind, n, at + 1).astype(np.int64), end


def _numbers(column: pa.Array) -> np.ndarray:
    if column.null_count:
        raise ValueError("a token has a text and offsets")
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _pack(lists: pa.Array, codec: pa.Codec) -> Iterator[bytes | None]:
    """Per list: its length, the gaps before tokens, lengths, bytes beyond these and the texts; mostly small and alike."""
    lists = lists.cast(ARROW_TYPE)
    flat = lists.flatten()
    token = flat.field("token")
    if flat.null_count:
        raise ValueError("a token has a text and offsets")
    start, end = (_numbers(flat.field(f)) for f in ("start", "end"))
    sizes = _numbers(pc.binary_length(token))
    counts = _numbers(pc.fill_null(pc.list_value_length(lists), 0))
    lasts = np.cumsum(counts)
    firsts = lasts - counts
    gap, length = start.copy(), end - start
    gap[1:] -= end[:-1]
    gap[firsts[counts > 0]] = start[firsts[counts > 0]]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = memoryview(b"")
    if len(token):
        begin = int(np.frombuffer(token.buffers()[1], np.int32, 1, 4 * token.offset)[0])
        data = memoryview(token.buffers()[2] or b"")[begin : begin + int(ends[-1])]
    for valid, a, b in zip(lists.is_valid().to_pylist(), firsts.tolist(), lasts.tolist(), strict=True):
        if not valid:
            yield None
            continue
        numbers = (_small(x[a:b]) for x in (gap, length, sizes - length))
        raw = b"".join([np.int64(b - a).tobytes(), *numbers, data[ends[a] : ends[b]]])
        yield np.int64(len(raw)).tobytes() + codec.compress(raw, asbytes=True)


def _few(lists: pa.Array) -> Iterator[pa.Array]:
    """Slices of some tokens each."""
    ends = np.cumsum(_numbers(pc.fill_null(pc.list_value_length(lists), 0)))
    begin, done = 0, 0
    while begin < len(lists):
        end = max(begin + 1, int(np.searchsorted(ends, done + FRAME_TOKENS, side="right")))
        yield lists[begin:end]
        begin, done = end, int(ends[end - 1])


def _frame(raws: list[bytes | None]) -> pa.Array:
    """The lists of some uncompressed binaries."""
    starts, ends, sizes, texts, counts = [], [], [], [], []
    for raw in raws:
        if raw is None:
            counts.append(0)
            continue
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        gap, at = _large(raw, 8, n)
        length, at = _large(raw, at, n)
        more, at = _large(raw, at, n)
        ends.append(np.cumsum(gap + length))
        starts.append(ends[-1] - length)
        sizes.append(length + more)
        texts.append(raw[at:])
        counts.append(n)
    none = np.empty(0, np.int64)
    edges = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32)
    token = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.tobytes()), pa.py_buffer(b"".join(texts)))
    values = pa.StructArray.from_arrays(
        [token, pa.array(np.concatenate([none, *starts])), pa.array(np.concatenate([none, *ends]))], ["token", "start", "end"]
    )
    offsets = pa.array(np.cumsum([0, *counts]).astype(np.int32))
    gone = pa.array([raw is None for raw in raws], pa.bool_())
    return pa.ListArray.from_arrays(offsets, values, mask=gone).cast(ARROW_TYPE)


@F.arrow_udf(T.BinaryType())
def pack_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Lists of tokens, whose fields are not null, as binaries; null as null."""
    codec = pa.Codec("zstd", compression_level=1)
    for lists in batches:
        packed = pa.array((blob for some in _few(lists) for blob in _pack(some, codec)), pa.binary())
        del lists  # before the next batch comes
        yield packed


@F.arrow_udf(TOKEN_TYPE)
def unpack_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The lists that ``pack_tokens`` packed, a few at a time."""
    codec = pa.Codec("zstd")
    for blobs in batches:
        raws, held = [], 0
        for blob in blobs:
            whole = blob.as_buffer()
            size = int(np.frombuffer(whole, np.int64, 1)[0]) if whole is not None else 0
            raws.append(None if whole is None else codec.decompress(whole.slice(8), size, asbytes=True))
            held += 4 * size
            if held >= FRAME_BYTES:
                yield _frame(raws)
                raws, held = [], 0
        if raws or not len(blobs):
            yield _frame(raws)
