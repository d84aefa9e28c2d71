"""Packs of documents, and which window anchors occur in more than one place.

Looking for repeats needs the same texts several times. They are therefore
packed: a pack is one row with some megabytes of whole documents, compressed,
under an id that is written to the shared folder with it. What is found out
about a pack is sent back to it by an equi-join on that id.

Packs exchange only 32 bits an anchor (in buckets by hash), once a pack: an
anchor that a third of all documents share is one entry a pack. Anchors of no
repeat, nearly all of them, end there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import _text
from loomline.llm._scratch import small_batches, written  # noqa: F401  used as part of this module

U = np.uint64
#: Bytes of text in a pack; a longer document is a pack of its own.
PACK = 2 << 20
#: Windows whose anchors are looked for at once.
SEGMENT = 1 << 19
#: An id that is null comes after all others.
LAST = np.iinfo(np.int64).max


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Packs of all documents: pack_id, ids, sizes (bytes), blob (zstd; a line feed after each text)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names, press = ["pack_id", "ids", "sizes", "blob"], zstandard.ZstdCompressor(level=3)
        base, n, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def out() -> pa.RecordBatch:
            blob = press.compress(b"".join(x + b"\n" for x in texts))
            return pa.RecordBatch.from_arrays([pa.array([base + n]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in texts]], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=names)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                x = t.as_py()
                if texts and size + len(x) > PACK:
                    yield out()
                    n, ids, texts, size = n + 1, [], [], 0
                ids.append(i)
                texts.append(x)
                size += len(x)
        if texts:
            yield out()

    return written(rows.mapInArrow(pack, "pack_id long, ids array<long>, sizes array<long>, blob binary"), "packs")


class Pack:
    """An unpacked pack: ids (null last), buf, begin and end of each text."""

    def __init__(self, row: dict) -> None:
        import zstandard

        self.pack_id = row["pack_id"]
        self.raw_ids = row["ids"]
        self.ids = np.array([LAST if x is None else x for x in row["ids"]], np.int64)
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["blob"]), np.uint8)
        size = np.array(row["sizes"], np.int64)
        self.end = np.cumsum(size + 1) - 1
        self.begin = self.end - size

    def words(self) -> tuple[np.ndarray, ...]:
        """Symbols (a hash a word), each word's document, start and end."""
        start, end = _text.words(self.buf)
        return _text.word_hashes(self.buf, start, end), np.searchsorted(self.end, start).astype(np.int32), start, end

    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (a hash a byte), each byte's document (what ends a text is in a document of its own)."""
        n = len(self.ids)
        size = np.stack((self.end - self.begin, np.ones(n, np.int64)), 1).ravel()
        owner = np.stack((np.arange(n), -1 - np.arange(n)), 1).ravel().astype(np.int32)
        return _text.byte_symbols(self.buf), np.repeat(owner, size)


def anchors(symbols: np.ndarray, doc: np.ndarray, length: int, k: int, live: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Anchors of a pack's windows, or those that begin where ``live`` is true
    (see :func:`_text.window_anchors`), found in segments of bounded size. A
    segment's edge may split an anchor's windows in two runs, each of them right."""
    parts = []
    for a in range(0, max(1, len(symbols) - length + 1), SEGMENT):
        end = a + SEGMENT + length - 1
        h, pos, first, count = _text.window_anchors(symbols[a:end], doc[a:end], length, k, None if live is None else live[a:end])
        parts.append((h, pos + a, first + a, count))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def each(packs: DataFrame, schema: str, f: Callable[[dict], Iterator[pa.RecordBatch]]) -> DataFrame:
    """f of every row, as a dict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from f({k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()})

    return packs.mapInArrow(run, schema)


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def bucket_bits(packs: DataFrame) -> int:
    """As many buckets as packs, so that a bucket stays as small as a pack
    however large the input is; a pack sends a row an anchor at most."""
    return int(min(31, max(4, packs.count().bit_length())))


def shortened(h: np.ndarray, bits: int) -> np.ndarray:
    """The first ``32 + bits`` bits of anchor hashes, mixed again: anchors are least hashes, so their own first bits are mostly 0."""
    return _text.mix(h ^ U(0x5851F42D4C957F2D)) >> U(32 - bits)


def planes(x: np.ndarray, width: int | None = None) -> bytes:
    """The low bytes of numbers that are not negative, plane by plane, compressed."""
    import zstandard

    width = width or max(1, (int(x.max()).bit_length() + 7) // 8 if len(x) else 1)
    low = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(low.tobytes())


def unplanes(x: bytes) -> np.ndarray:
    import zstandard

    width = x[0]
    low = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((low.shape[1], 8), np.uint8)
    out[:, :width] = low.T
    return out.view("<u8").ravel()


def in_buckets(high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending bucket numbers: the buckets, and where each begins."""
    cut = np.flatnonzero(np.diff(high.astype(np.int64), prepend=-1))
    return high[cut].astype(np.int64), cut


def repeated(packs: DataFrame, anchors_of: Callable[[dict], np.ndarray], bits: int, hot: int) -> DataFrame:
    """By pack: ``marks``, for each bucket bit masks of the pack's own distinct
    shortened anchors: those that other packs have as well, and those that at
    least ``hot`` packs have (see :func:`marked`)."""

    def blocks(row: dict) -> Iterator[pa.RecordBatch]:
        short = np.unique(shortened(anchors_of(row), bits))
        if len(short):
            bucket, cut = in_buckets(short >> U(32))
            data = [x.tobytes() for x in np.split(short.astype(np.uint32), cut[1:])]
            yield table(pack_id=pa.array([row["pack_id"]] * len(cut), pa.int64()), bucket=pa.array(bucket, pa.int32()), data=pa.array(data, pa.binary()))

    def shared(part: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(x, np.uint32) for x in part["data"]]
        _, at, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        told = np.split(count[at], np.cumsum([len(x) for x in own])[:-1])
        return pd.DataFrame({"pack_id": part["pack_id"], "bucket": part["bucket"], "many": [np.packbits(x > 1).tobytes() for x in told], "hot": [np.packbits(x >= hot).tobytes() for x in told]})

    blocks_of = each(packs, "pack_id long, bucket int, data binary", blocks)
    hits = blocks_of.groupBy("bucket").applyInPandas(shared, "pack_id long, bucket int, many binary, hot binary")
    # a pack has one row a bucket at most
    return hits.groupBy("pack_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "many", "hot"))).alias("marks"))


def marked(short: np.ndarray, marks: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pack's shortened anchors other packs have, and which very many have."""
    if not marks:
        return np.zeros(len(short), bool), np.zeros(len(short), bool)
    own, at = np.unique(short, return_inverse=True)
    _, cut = in_buckets(own >> U(32))
    size = np.diff(np.append(cut, len(own)))
    return tuple(np.concatenate([np.unpackbits(np.frombuffer(m[k], np.uint8), count=n) for m, n in zip(marks, size.tolist(), strict=True)]).astype(bool)[at] for k in ("many", "hot"))


def with_notes(packs: DataFrame, notes: DataFrame) -> DataFrame:
    """Each pack with its row of notes. The notes are the hashed side, so blobs are never sorted."""
    return packs.join(notes.hint("shuffle_hash"), "pack_id", "left")


def least_by(keys: list[np.ndarray], value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of keys: index of one of each, least and greatest value."""
    order = np.lexsort((value, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[order][1:] != x[order][:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    return order[first], value[order[first]], value[order[last[: len(first)]]]


def classes(keys: list[np.ndarray], value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`least_by`, and the class of each row."""
    one, lo, hi = least_by(keys, value)
    order = np.lexsort((value, *keys[::-1]))
    new = np.zeros(len(order), bool)
    for x in keys:
        new[1:] |= x[order][1:] != x[order][:-1]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new)
    return one, lo, hi, of


def expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of anchors: each window's anchor (by index) and start."""
    which = np.repeat(np.arange(len(first)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


def covered(starts: np.ndarray, length: int, n: int, begin: np.ndarray | tuple = (), end: np.ndarray | tuple = ()) -> np.ndarray:
    """Which of n symbols are in a window that begins at one of the starts, or in a span [begin, end)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    np.add.at(step, np.asarray(begin, np.int64), 1)
    np.add.at(step, np.asarray(end, np.int64), -1)
    return np.cumsum(step[:-1]) > 0


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())
