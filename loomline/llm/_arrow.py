"""Texts of Arrow batches as byte arrays, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that the kernels work on at once; a longer text is a slice of its own.
SLICE = 1 << 20


def text_slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type) or not pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
        kind = np.int64
    else:
        kind = np.int32
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    size = np.diff(off)
    if texts.null_count:
        size = np.where(texts.is_null().to_numpy(zero_copy_only=False), 0, size)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(np.cumsum(size[a : a + 65536]), most, "right")) + a)
        if texts.null_count and int(size[a:b].sum()) != int(off[b] - off[a]):
            buf = np.concatenate([raw[off[i] : off[i] + size[i]] for i in range(a, b)])
        else:
            buf = raw[off[a] : off[b]]
        yield a, b, buf, np.concatenate(([0], np.cumsum(size[a:b])))
        a = b


def slice_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of a slice, and the first word of each row (with a last entry: the number of words)."""
    from loomline.llm._text import _SPACE

    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space, edge = _SPACE[buf], np.zeros(len(buf), bool)
    edge[off[:-1][np.diff(off) > 0]] = True
    begins, ends = ~space, ~space
    begins[1:] &= space[:-1] | edge[1:]
    ends[:-1] &= space[1:] | edge[1:]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, off)
